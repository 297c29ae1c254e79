"""Messages of chat hooks as Columns (X44): one wide event row in, the parts of Slack, Discord and DingTalk messages out.

An event row has the columns of ``FIELDS`` that its event needs; the others may be null. Events:
create, delete, fork, push, issues, issue_comment, pull_request, release. Unknown events and actions give
a null message.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of an event row, as DDL.
FIELDS = """event string, action string, ref string, ref_type string, repo string, full_name string, url string, site string, sender string,
pusher string, fork string, fork_url string, compare_url string, commits array<struct<id: string, url: string, message: string, author: string>>,
index bigint, title string, body string, assignee string, milestone string, labels array<string>, merged boolean, comment_id bigint, comment string,
tag string, release_name string, draft boolean, prerelease boolean"""

#: What happened to an issue or pull request, by action.
HAPPENED = {
    "closed": "closed", "reopened": "re-opened", "edited": "edited", "unassigned": "unassigned", "label_updated": "labels updated",
    "label_cleared": "labels cleared", "milestoned": "milestoned", "demilestoned": "demilestoned",
}
ISSUES, PULLS, COMMENTS = "issues", "pull_request", "issue_comment"
C, L = F.col, F.lit


def joined(*parts) -> Column:
    """Parts (Columns, or text) put together; a null part is empty."""
    return F.concat(*[L(p) if isinstance(p, str) else F.coalesce(p.cast("string"), L("")) for p in parts])


def choose(cases: dict, of: Column) -> Column:
    out = F.when(L(False), L(None).cast("string"))
    for name, value in cases.items():
        out = out.when(of == name, L(value) if isinstance(value, str) else value)
    return out


def short_ref() -> Column:
    return F.regexp_replace("ref", "^refs/(heads|tags)/", "")


def place(path: str) -> Column:
    return joined(C("url"), f"/{path}/", C("index"))


def comment_place() -> Column:
    return F.when(C("action") == "deleted", place("issues")).otherwise(joined(place("issues"), "#issuecomment-", C("comment_id")))


def numbered() -> Column:
    return joined("#", C("index"), " ", C("title"))


def new_commits() -> Column:
    n = F.size(F.coalesce("commits", F.array().cast("array<struct<id: string, url: string, message: string, author: string>>")))
    return F.when(n == 1, "1 new commit").otherwise(joined(n, " new commits"))


def each_commit(line) -> Column:
    """Lines of the commits, one below the other."""
    return F.array_join(F.transform("commits", line), "\n")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, L(a), L(b))
    return c


def first_line(c: Column) -> Column:
    return F.split(c, "\n", 2)[0]


# ---- Slack ------------------------------------------------------------------------------


def slack_link(url: Column, label: Column) -> Column:
    return joined("<", url, "|", escaped(label), ">")


def slack() -> Column:
    """struct(text, title, attachment): the message, and an attachment's title and text."""
    home, at = slack_link(C("url"), C("repo")), slack_link(joined(C("url"), "/src/", short_ref()), short_ref())
    person = lambda c: slack_link(joined(C("site"), c), c)
    pushed = F.when(F.length("compare_url") > 0, slack_link(C("compare_url"), new_commits())).otherwise(new_commits())

    def thing(name: str, opened: str, path: str, more: tuple[str, ...]) -> tuple[Column, Column, Column]:
        link, by = slack_link(place(path), numbered()), joined(" by ", person(C("sender")))
        head = joined("[", C("full_name"), "] ")
        cases = {k: joined(head, f"{name} {v}: ", link, by) for k, v in HAPPENED.items()} | {k: joined(head, f"{name} {k}: ", link, by) for k in more}
        if name == "Pull request":
            cases["closed"] = F.when(C("merged"), joined(head, "Pull request merged: ", link, by)).otherwise(cases["closed"])
        cases |= {"opened": joined(head, opened, by), "assigned": joined(head, f"{name} assigned to ", person(C("assignee")), ": ", link, by)}
        return choose(cases, C("action")), F.when(C("action") == "opened", link), F.when(C("action").isin("opened", "edited"), escaped(F.coalesce("body", L(""))))

    issue, pull = thing("Issue", "New issue created", "issues", ()), thing("Pull request", "Pull request submitted", "pulls", ("synchronized",))
    said = choose({"created": "New comment created", "edited": "Comment edited", "deleted": "Comment deleted"}, C("action"))
    text = choose({
        "create": joined("[", home, ":", at, "] ", C("ref_type"), " created by ", C("sender")),
        "delete": joined("[", home, ":", short_ref(), "] ", C("ref_type"), " deleted by ", C("sender")),
        "fork": joined(home, " is forked to ", slack_link(C("fork_url"), C("fork"))),
        "push": joined("[", home, ":", at, "] ", pushed, " pushed by ", C("pusher")),
        ISSUES: issue[0], PULLS: pull[0],
        COMMENTS: F.when(said.isNotNull(), joined("[", C("full_name"), "] ", said, " by ", person(C("sender")))),
        "release": joined("[", home, "] new release ", slack_link(joined(C("url"), "/src/", C("tag")), C("tag")), " published by ", C("sender")),
    }, C("event"))
    commit = lambda c: joined(slack_link(c["url"], F.substring(c["id"], 1, 7)), ": ", escaped(first_line(c["message"])), " - ", escaped(c["author"]))
    title = choose({ISSUES: issue[1], PULLS: pull[1], COMMENTS: slack_link(comment_place(), numbered())}, C("event"))
    more = choose({"push": each_commit(commit), ISSUES: issue[2], PULLS: pull[2], COMMENTS: escaped(C("comment"))}, C("event"))
    return F.struct(text.alias("text"), F.coalesce(title, L("")).alias("title"), F.coalesce(more, L("")).alias("attachment"))


# ---- Discord ----------------------------------------------------------------------------


def markdown_link(url: Column, label: Column) -> Column:
    return joined("[", label, "](", url, ")")


def discord() -> Column:
    """struct(title, description, url, footer, fields): an embed; ``color`` of a hook is ``colour`` of its hex text."""
    home, at = markdown_link(C("url"), C("repo")), markdown_link(joined(C("url"), "/src/", short_ref()), short_ref())
    pushed = F.when(F.length("compare_url") > 0, markdown_link(C("compare_url"), new_commits())).otherwise(new_commits())
    commit = lambda c: joined("[`", F.substring(c["id"], 1, 7), "`](", c["url"], ") ", first_line(c["message"]), " - ", c["author"])
    profile = joined(C("site"), C("sender"))

    def titled(name: str, opened: str) -> Column:
        cases = {k: f"{name} {v}: " for k, v in (HAPPENED | {"assigned": "assigned", "synchronized": "synchronized"}).items()} | {"opened": f"{opened}: "}
        if name == "Pull request":
            cases["closed"] = F.when(C("merged"), "Pull request merged: ").otherwise("Pull request closed: ")
        return joined(F.coalesce(choose(cases, C("action")), L("")), numbered())

    said = choose({"created": "New comment: ", "edited": "Comment edited: ", "deleted": "Comment deleted: "}, C("action"))
    title = choose({ISSUES: titled("Issue", "New issue"), PULLS: titled("Pull request", "New pull request"), COMMENTS: joined(said, numbered())}, C("event"))
    body = F.when(C("action").isin("opened", "edited"), C("body"))
    text = choose({
        "create": joined("Created new ", C("ref_type"), ": ", home, "/", at),
        "delete": joined("Deleted ", C("ref_type"), ": ", home, "/", short_ref()),
        "fork": joined(home, " is forked to ", markdown_link(C("fork_url"), C("fork"))),
        "push": joined("Pushed ", pushed, " to ", home, "/", at, "\n", each_commit(commit)),
        ISSUES: joined(body), PULLS: joined(body), COMMENTS: C("comment"),
        "release": joined("Published new release ", markdown_link(joined(C("url"), "/src/", C("tag")), C("tag")), " of ", home),
    }, C("event"))
    where = choose({ISSUES: place("issues"), PULLS: place("pulls"), COMMENTS: comment_place()}, C("event"))
    label_text = F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ", ")
    label_text = F.when((C("event") == ISSUES) & (label_text == ""), "<empty>").otherwise(label_text)
    field = lambda name, value: F.array(F.struct(L(name).alias("name"), value.alias("value")))
    fields = F.when(C("action") == "assigned", field("New Assignee", C("assignee"))).when(C("action") == "label_updated", field("Labels", label_text)).when(C("action") == "milestoned", field("New Milestone", C("milestone")))
    none = F.array().cast("array<struct<name: string, value: string>>")
    long = C("event").isin(ISSUES, PULLS)
    return F.struct(F.coalesce(title, L("")).alias("title"), text.alias("description"), F.coalesce(where, profile).alias("url"), F.when(title.isNotNull(), C("full_name")).otherwise("").alias("footer"), F.coalesce(F.when(long, fields), none).alias("fields"))


def colour(c: Column) -> Column:
    """The number of a colour's hex text; 0 for other text."""
    return F.coalesce(F.conv(F.regexp_extract(c, "^#*([0-9a-fA-F]+)$", 1), 16, 10).cast("int"), L(0))


# ---- DingTalk ---------------------------------------------------------------------------


def headed(c: Column) -> Column:
    return joined(F.upper(F.substring(c, 1, 1)), F.substring(c, L(2), F.length(c)))


def dingtalk() -> Column:
    """struct(button, button_url, text): an action card."""
    bold = lambda c: joined("**", c, "**")
    kind, at = headed(C("ref_type")), joined(C("url"), "/src/", short_ref())
    home, here = bold(markdown_link(C("url"), C("repo"))), bold(markdown_link(at, short_ref()))
    commits = F.transform("commits", lambda c, i: joined("> ", i, ". ", markdown_link(c["url"], F.substring(c["id"], 1, 7)), " ", c["author"], " - ", first_line(c["message"]), "\n"))
    n = F.size(F.coalesce("commits", F.array().cast("array<struct<id: string, url: string, message: string, author: string>>")))
    bold_labels = F.array_join(F.transform("labels", bold), ",")
    acted, quoted = headed(C("action")), joined("\n> ", C("body"))
    is_ = lambda action, text: F.when(C("action") == action, text).otherwise("")
    issue = joined(
        "# Issue Event ", acted, "\n- Issue: ", bold(markdown_link(place("issues"), numbered())),
        is_("assigned", joined("\n- New Assignee: ", bold(C("assignee")))), is_("milestoned", joined("\n- New Milestone: ", bold(C("milestone")))),
        is_("label_updated", joined("\n- Labels: ", F.when(F.size("labels") > 0, bold_labels).otherwise("**empty**"))),
        F.when(F.length("body") > 0, quoted).otherwise(""),
    )
    pull = joined(
        "# Pull Request ", F.when((C("action") == "closed") & C("merged"), "Merged").otherwise(acted), "\n- PR: ", markdown_link(place("pulls"), numbered()),
        is_("assigned", joined("\n- New Assignee: ", bold(C("assignee")))), is_("milestoned", joined("\n- New Milestone: *", C("milestone"), "*")),
        is_("label_updated", joined("\n- New Labels: ", bold_labels)), F.when(C("action").isin("opened", "edited"), quoted).otherwise(""),
    )
    release_url = joined(C("url"), "/src/", C("tag"))
    release = joined(
        "# New Release Published\n- Repo: ", markdown_link(C("url"), C("repo")), "\n- Tag: ", markdown_link(release_url, C("tag")), "\n- Author: ", C("sender"),
        "\n- Draft?: ", C("draft"), "\n- Pre Release?: ", C("prerelease"), "\n- Title: ", C("release_name"), F.when(F.length("body") > 0, joined("\n- Note: ", C("body"))).otherwise(""),
    )
    text = choose({
        "create": joined("# New ", kind, " Create Event\n- Repo: ", home, "\n- New ", kind, ": ", here),
        "delete": joined("# ", kind, " Delete Event\n- Repo: ", home, "\n- ", kind, ": ", bold(short_ref())),
        "fork": joined("# Repo Fork Event\n- From Repo: ", home, "\n- To Repo: ", bold(markdown_link(C("fork_url"), C("fork")))),
        "push": joined("# Repo Push Event\n- Repo: ", home, "\n- Ref: ", here, "\n- Pusher: ", bold(C("pusher")), "\n## Total ", n, " commits(s)\n", F.array_join(commits, "")),
        ISSUES: issue, PULLS: pull, "release": release,
        COMMENTS: joined("# Issue Comment ", acted, "\n- Issue: ", markdown_link(place("issues"), numbered()), "\n- Comment content: \n> ", C("comment")),
    }, C("event"))
    button = choose({"create": joined("View ", kind), "delete": "View Repo", "fork": "View Fork", "push": "View Changes", ISSUES: "View Issue", COMMENTS: "View Issue Comment", PULLS: "View Pull Request", "release": "View Release"}, C("event"))
    to = choose({"create": at, "delete": C("url"), "fork": C("fork_url"), "push": C("compare_url"), ISSUES: place("issues"), COMMENTS: comment_place(), PULLS: place("pulls"), "release": release_url}, C("event"))
    return F.struct(button.alias("button"), to.alias("button_url"), text.alias("text"))
