"""Scalar and text functions as Columns (X1-X47 without those that need Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the site's markup.
MENTION = r"(\s|^|\W)@[0-9a-zA-Z\-_\.]+"
ISSUE_NUMBER = r"( |^|\(|\[)#[0-9]+\b"
ISSUE_NAME = r"( |^|\(|\[)[A-Z]{1,10}-[1-9][0-9]*\b"
CROSS_ISSUE = r"( |^)[0-9a-zA-Z\-_\.]+/[0-9a-zA-Z\-_\.]+#[0-9]+\b"
SHA = r"\b[0-9a-f]{7,40}\b"
REFERENCE = r"(?i)(^| )\S*#\d+"
CLOSE = r"(?i)(?:close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved) \S+"
REOPEN = r"(?i)(?:reopen|reopens|reopened) \S+"
LINK = r"^[a-z][\w-]+://|^mailto:"

call = F.call_function


def found(c: Column, pattern: str) -> Column:
    """All whole matches of a pattern."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def replaced_matches(c: Column, pattern: str, change) -> Column:
    """Every match of a pattern replaced by ``change(match)``, in place."""
    rest = F.split(c, pattern, -1)
    changed = F.transform(found(c, pattern), change)
    both = F.zip_with(rest, F.concat(changed, F.array(F.lit(""))), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(F.flatten(both), "")


def mentions(c: Column) -> Column:
    """Names mentioned with ``@``, in order, repeats included."""
    return F.transform(found(c, MENTION), lambda m: F.regexp_replace(m, r"^[^@]*@", ""))


def anchor(to: Column, label: Column) -> Column:
    return F.concat(F.lit('<a href="'), to, F.lit('">'), label, F.lit("</a>"))


def before(m: Column, sign: str) -> Column:
    """What a match holds before the last ``sign``."""
    return F.regexp_extract(m, f"(?s)^(.*){sign}", 1)


def issue_link(m: Column, prefix: str, style: str = "numeric", external: str = "") -> Column:
    named = style == "alphanumeric"
    lead = F.regexp_extract(m, r"^([ (\[]?)", 1)
    name = F.regexp_replace(m, r"^[ (\[]", "")
    index = name if named and external else F.substring(name, F.lit(2), F.length(name))
    url = F.replace(F.lit(external), F.lit("{index}"), index) if external else F.concat(F.lit(f"{prefix}/issues/"), index)
    return F.concat(lead, anchor(url, name))


def issue_links(c: Column, prefix: str, style: str = "numeric", external: str = "") -> Column:
    """Issue references as links; ``external`` is a format with ``{index}`` (other trackers)."""
    return replaced_matches(c, ISSUE_NAME if style == "alphanumeric" else ISSUE_NUMBER, lambda m: issue_link(m, prefix, style, external))


def cross_link(m: Column, site: str) -> Column:
    name = F.regexp_replace(m, r"^ ", "")
    return F.concat(F.regexp_extract(m, "^( ?)", 1), anchor(F.concat(F.lit(site), F.substring_index(name, "#", 1), F.lit("/issues/"), F.substring_index(name, "#", -1)), name))


def cross_links(c: Column, site: str) -> Column:
    """References to issues of other repositories as links."""
    return replaced_matches(c, CROSS_ISSUE, lambda m: cross_link(m, site))


def short_sha(c: Column) -> Column:
    return F.substring(c, 1, 10)


def is_plain_number(c: Column) -> Column:
    """Digits that aren't all zero: no commit."""
    return c.rlike("^[0-9]+$") & c.rlike("[1-9]")


def shas(c: Column) -> Column:
    """Commit-like words that aren't plain numbers."""
    return F.filter(found(c, SHA), lambda m: ~is_plain_number(m))


def sha_link(m: Column, repo_link: str) -> Column:
    return F.when(is_plain_number(m), m).otherwise(F.concat(F.lit(f'<a href="{repo_link}/commit/'), m, F.lit('"><code>'), short_sha(m), F.lit("</code></a>")))


def sha_links(c: Column, repo_link: str) -> Column:
    return replaced_matches(c, SHA, lambda m: sha_link(m, repo_link))


def mention_link(m: Column, subpath: str = "") -> Column:
    name = F.substring_index(m, "@", -1)
    return F.concat(before(m, "@"), anchor(F.concat(F.lit(f"{subpath}/"), name), F.concat(F.lit("@"), name)))


def mention_links(c: Column, subpath: str = "") -> Column:
    """Each mention as a link, at its place."""
    return replaced_matches(c, MENTION, lambda m: mention_link(m, subpath))


def auto_link(url: Column, site: str, prefix: str) -> Column:
    """A bare URL as a link: this site's commits by short SHA, its issues by number (with the repository if another), others in full."""
    commit = r"^https?.*commit/([0-9a-zA-Z]+)(?:#+[0-9a-zA-Z-]*)?"
    issue = r"^https?.*issues/([0-9]+)(?:#+[0-9a-zA-Z-]*)?"
    whole = lambda p: F.regexp_extract(url, p, 0)
    link = lambda to, label: F.concat(F.lit('<a href="'), to, F.lit('">'), label, F.lit("</a>"))
    number = F.concat(F.lit("#"), F.regexp_extract(url, issue, 1))
    repo = F.regexp_replace(F.substring(whole(issue), F.lit(len(site) + 1), F.length(url)), r"/issues/.*$", "")
    here = whole(issue).startswith(site + prefix.removeprefix("/"))
    own = F.when(url.rlike(commit), F.concat(F.lit(" <code>"), link(whole(commit), short_sha(F.regexp_extract(url, commit, 1))), F.lit("</code>")))
    own = own.when(url.rlike(issue), link(whole(issue), F.when(here, number).otherwise(F.concat(repo, number))))
    return F.when(url.startswith(site) & (url.rlike(commit) | url.rlike(issue)), own).otherwise(link(url, escape_html(url)))


#: All that ``special_links`` makes links of, tried in this order at each place.
SPECIAL = "|".join((MENTION, ISSUE_NUMBER, CROSS_ISSUE, SHA))


def special_links(c: Column, prefix: str, repo_link: str, site: str, subpath: str = "") -> Column:
    """Mentions, issues, other repositories' issues and commits as links.

    One pass from left to right: each is replaced at its own place, so no link is made inside
    another one and equal or overlapping names (``@ann @anna``) stay apart.
    """
    whole = lambda m, pattern: m.rlike(f"^(?:{pattern})$")
    one = lambda m: F.when(whole(m, MENTION), mention_link(m, subpath)).when(whole(m, ISSUE_NUMBER), issue_link(m, prefix)).when(whole(m, CROSS_ISSUE), cross_link(m, site)).otherwise(sha_link(m, repo_link))
    return replaced_matches(c, SPECIAL, one)


def references(c: Column, pattern: str, repo: str) -> Column:
    """Distinct ``owner/name#index`` that a commit message refers to; a bare ``#n`` gets ``repo``; names without owner don't count."""
    cut = lambda m: F.regexp_replace(F.regexp_replace(F.trim(m) if pattern == REFERENCE else F.regexp_replace(m, r"^\S* ", ""), r"\D+$", ""), r"^#", f"{repo}#")
    refs = F.transform(found(c, pattern), cut)
    return F.array_distinct(F.filter(refs, lambda r: r.rlike(r"^[^#]*/[^#]*#0*[1-9]\d*$")))


def reference(c: Column) -> Column:
    """(owner, name, index) of ``owner/name#index``; null if it isn't one, or the index is 0."""
    index = F.regexp_extract(c, r"#0*(\d{1,10})$", 1).try_cast("bigint")
    return F.when(c.rlike(r"^[^/#]+/[^/#]+#0*[1-9]\d{0,9}$"), F.struct(F.substring_index(c, "/", 1).alias("owner"), F.regexp_extract(c, r"/([^/#]+)#", 1).alias("name"), index.alias("index")))


def mirror_updates(c: Column) -> Column:
    """(ref, old, new) of each update that a fetch log reports; other lines don't count.

    New references have old, deleted ones new ``0000000``.
    """
    none = F.lit("0000000")

    def one(line):
        ref = F.regexp_replace(line, r"^.*?-> ", "")
        ends = F.split(F.regexp_extract(line, r"^   ([^ ]*) ", 1), r"\.\.")
        made = lambda old, new: F.struct(ref.alias("ref"), old.alias("old"), new.alias("new"))
        changed = line.startswith("   ") & (F.size(ends) == 2)
        return F.when(~line.contains("-> "), None).when(line.startswith(" * "), made(none, F.lit(""))).when(line.startswith(" - "), made(F.lit(""), none)).when(changed, made(ends[0], ends[1]))

    return F.filter(F.transform(F.split(c, "\n"), one), lambda x: x.isNotNull())


def without_credentials(url: Column, mark: bool = False) -> Column:
    """A URL without its user part, or with ``<credentials>`` in place of it."""
    at, start = F.locate("@", url), F.locate("://", url)
    head = F.substring(url, F.lit(1), start + 2)
    tail = F.substring(url, at if mark else at + 1, F.length(url))
    return F.when((at == 0) | (start == 0), url).otherwise(F.concat(head, F.lit("<credentials>" if mark else ""), tail))


def submodule_url(base: Column, url: Column, commit: Column) -> Column:
    """Where a submodule's commit can be seen."""
    base = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    raw = F.regexp_replace(F.regexp_replace(url, "/$", ""), r"\.git$", "")
    tail = F.concat(F.lit("/commit/"), commit)
    ssh = r"^ssh://(?:[^@/]*@)?([^:/]+)(?::\d+)?(/.*)?$"
    scp = r"^([a-zA-Z0-9_]+@)?([a-zA-Z0-9._-]+):(.*)$"
    return (
        F.when(raw.startswith("../"), F.concat(base, raw, tail))
        .when(raw.rlike("^https?://"), F.concat(raw, tail))
        .when(raw.rlike(ssh), F.concat(F.lit("http://"), F.regexp_extract(raw, ssh, 1), F.regexp_extract(raw, ssh, 2), tail))
        .when(raw.rlike("^[a-z]+://"), raw)
        .when(raw.rlike(scp), F.concat(F.lit("http://"), F.regexp_extract(raw, scp, 2), F.lit("/"), F.regexp_replace(F.regexp_extract(raw, scp, 3), "^/", ""), tail))
        .otherwise(raw)
    )


#: Units of sizes and of time.
SIZES = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
UNITS = [("year", 31104000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60)]


def file_size(c: Column) -> Column:
    """Base 1024; below 10 bytes plain, values below 10 with one decimal, else none; halves round to even."""
    value, unit = c.cast("double"), F.lit(SIZES[0])
    for i, name in enumerate(SIZES[1:], 1):
        value = F.when(c >= F.lit(1024**i), c.cast("double") / float(1024**i)).otherwise(value)
        unit = F.when(c >= F.lit(1024**i), F.lit(name)).otherwise(unit)
    tenths = F.bround(value, 1)
    text = F.when(value < 10, F.concat(tenths.cast("decimal(20,1)").cast("string"))).otherwise(F.bround(value, 0).cast("bigint").cast("string"))
    return F.when(c < 10, F.concat(c.cast("string"), F.lit(" B"))).otherwise(F.concat(text, F.lit(" "), unit))


def one_unit(seconds: Column) -> Column:
    """An interval in its largest unit; a month is 30 days, a year 12 months."""
    out = F.when(seconds <= 0, F.lit("now")).when(seconds < 2, F.lit("1 second"))
    out = out.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" seconds")))
    for name, length in reversed(UNITS):
        n = F.floor(seconds / length)
        top = {"minute": 3600, "hour": 86400, "day": 604800, "week": 2592000, "month": 31104000}.get(name)
        out = out.when(F.lit(True) if top is None else seconds < top, F.when(n == 1, F.lit(f"1 {name}")).otherwise(F.concat(n.cast("string"), F.lit(f" {name}s"))))
    return out


def all_units(seconds: Column) -> Column:
    """An interval in all its units joined by commas; ``future`` if negative, empty if none. Years end it: what is left of them is dropped."""
    year = UNITS[0][1]
    rest = F.when(seconds >= 2 * year, F.lit(0)).otherwise(seconds % year)
    spans = [(name, length, above) for (name, length), (_, above) in zip([*UNITS[1:], ("second", 1)], UNITS)]
    amounts = [("year", F.floor(seconds / year)), *[(name, F.floor(rest % above / length)) for name, length, above in spans]]
    parts = [F.when(n == 1, f"1 {name}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {name}s"))) for name, n in amounts]
    return F.when(seconds < 0, F.lit("future")).otherwise(F.concat_ws(", ", *parts))


def ellipsis(c: Column, n: int) -> Column:
    """Texts over ``n`` characters cut there, with three dots. Characters, not bytes, so no letter is cut in half."""
    return c if n < 0 else F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_text(*columns: Column) -> Column:
    """The first text that isn't empty; else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def contains_fold(items: Column, c: Column) -> Column:
    return F.array_contains(F.transform(items, F.lower), F.lower(c))


def to_longs(c: Column, separator: str = ",") -> Column:
    """A list in text as numbers; what isn't one becomes 0."""
    return F.transform(F.split(c, separator), lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d{1,18}$"), F.trim(x).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def email_hash(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)).cast("binary"))


def avatar(c: Column, source: str = "https://secure.gravatar.com/avatar/") -> Column:
    return F.concat(F.lit(source), email_hash(c), F.lit("?d=identicon"))


def time_limited_code(data: Column, start: Column, minutes: Column, secret: str) -> Column:
    """12 digits of the start, 6 of the minutes, and a SHA-1 over data, secret, start, end and minutes."""
    begin = F.date_format(start, "yyyyMMddHHmm")
    end = F.date_format(start + F.make_interval(mins=minutes), "yyyyMMddHHmm")
    body = F.concat(data, F.lit(secret), begin, end, minutes.cast("string"))
    return F.concat(begin, F.lpad(minutes.cast("string"), 6, "0"), F.sha1(body.cast("binary")))


def code_is_valid(code: Column, data: Column, now: Column, secret: str) -> Column:
    """Whether a code is of these data and not expired at ``now``."""
    start = F.to_timestamp(F.substring(code, 1, 12), "yyyyMMddHHmm")
    minutes = F.when(F.substring(code, 13, 6).rlike(r"^\d{6}$"), F.substring(code, 13, 6).cast("int"))
    same = time_limited_code(data, start, minutes, secret) == code
    return F.coalesce((F.length(code) == 58) & same & (minutes > 0) & (start + F.make_interval(mins=minutes) > now), F.lit(False))


def encrypt(c: Column, key: Column) -> Column:
    return F.aes_encrypt(c, key, F.lit("GCM"))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(c, key, F.lit("GCM"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def commit_message(c: Column, prefix: str, full: bool = True) -> Column:
    """A message with issue links: its first line as a head, the rest preformatted, or all lines as a head if no empty line follows the first."""
    lines = F.split(F.regexp_replace(issue_links(escape_html(c), prefix), r"^\s+|\s+$", ""), "\n")
    if not full:
        return lines[0]
    head = F.concat(F.lit("<h3>"), lines[0], F.lit("</h3>"))
    rest = F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(F.size(lines) == 1, head).when(lines[1] == "", F.concat(head, F.lit("\n<pre>"), rest, F.lit("</pre>"))).otherwise(F.concat(F.lit("<h4>"), F.array_join(lines, "<br>"), F.lit("</h4>")))


#: Icons of action types.
ICONS = {
    "repo": [1, 8], "git-commit": [5], "issue-opened": [6], "git-pull-request": [7], "tag": [9], "comment-discussion": [10],
    "git-merge": [11], "issue-closed": [12, 14], "issue-reopened": [13, 15], "git-branch": [16], "alert": [17, 18],
    "repo-forked": [19], "repo-clone": [20, 21, 22],
}


def action_icon(c: Column) -> Column:
    out = F.lit("invalid type")
    for name, types in ICONS.items():
        out = F.when(c.isin(types), name).otherwise(out)
    return out


def text_colour(c: Column) -> Column:
    """White on dark labels, black on light ones and on what is no colour."""
    value = F.conv(F.substring(c, F.lit(2), F.length(c)), 16, 10).cast("bigint")
    part = lambda shift: F.shiftright(value, shift).bitwiseAND(F.lit(255))
    light = (0.2126 * part(16) + 0.7152 * part(8) + 0.0722 * part(0)) / 255
    return F.when(c.rlike("^#[0-9a-fA-F]{1,15}$") & (light < 0.66), "#fff").otherwise("#000")


def line_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def escape_pound(c: Column) -> Column:
    for a, b in (("%", "%25"), ("#", "%23"), (" ", "%20"), ("?", "%3F")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def same_site(c: Column) -> Column:
    """A path of this site: one slash, and neither slash nor backslash after it."""
    return F.coalesce(c.rlike(r"^/[^/\\]"), F.lit(False))


def clean_path(c: Column) -> Column:
    """A relative path without ``.``, ``..`` and doubled slashes that can't leave its folder."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def compare_path(owner: Column, repo: Column, old: Column, new: Column) -> Column:
    return F.concat(owner, F.lit("/"), repo, F.lit("/compare/"), old, F.lit("..."), new)


def repo_url(site: str, owner: Column, repo: Column) -> Column:
    return F.concat(F.lit(site), owner, F.lit("/"), repo)


MODES = ["none", "read", "write", "admin", "owner"]


def mode_name(c: Column) -> Column:
    return F.when(c.between(0, 4), F.element_at(F.array(*map(F.lit, MODES)), c.cast("int") + 1)).otherwise("none")


def mode_of(c: Column) -> Column:
    """The mode of a name; unknown names read."""
    return F.when(c == "write", 2).when(c == "admin", 3).otherwise(1).cast("bigint")


def chat_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chat_link(url: Column, label: Column) -> Column:
    return F.concat(F.lit("<"), url, F.lit("|"), chat_escape(label), F.lit(">"))


def chat_text(event: Column, repo: Column, url: Column, ref: Column, sender: Column, n: Column) -> Column:
    """The message of a chat hook for creations, deletions, forks and pushes; null for other events."""
    home, place = chat_link(url, repo), chat_link(F.concat(url, F.lit("/src/"), ref), ref)
    pushed = F.when(n == 1, F.lit("1 new commit")).otherwise(F.concat(n.cast("string"), F.lit(" new commits")))
    return (
        F.when(event == "create", F.concat(F.lit("["), home, F.lit(":"), place, F.lit("] branch created by "), sender))
        .when(event == "delete", F.concat(F.lit("["), home, F.lit(":"), ref, F.lit("] branch deleted by "), sender))
        .when(event == "fork", F.concat(home, F.lit(" is forked to "), chat_link(url, F.concat(sender, F.lit("/"), repo))))
        .when(event == "push", F.concat(F.lit("["), home, F.lit(":"), place, F.lit("] "), pushed, F.lit(" pushed by "), sender))
    )


def markup_kind(name: Column) -> Column:
    """markdown, orgmode, ipynb or empty, by file name."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.(md|markdown|mdown|mkd)$"), "markdown").when(low.endswith(".org"), "orgmode").when(low.endswith(".ipynb"), "ipynb").otherwise("")


def is_readme(name: Column) -> Column:
    return F.lower(name).rlike(r"^readme(\..*)?$")


def task_item(c: Column) -> Column:
    """Task-list marks as check boxes."""
    rest = F.substring(c, F.lit(4), F.length(c))
    return F.when(c.startswith("[ ] "), F.concat(F.lit('<input type="checkbox" disabled="" />'), rest)).when(c.startswith("[x] "), F.concat(F.lit('<input type="checkbox" disabled="" checked="" />'), rest)).otherwise(c)


def resolved_link(c: Column, prefix: str) -> Column:
    """Relative links joined with the prefix; absolute ones, anchors and empty ones stay."""
    joined = F.concat(F.lit("/" if prefix.startswith("/") else ""), clean_path(F.concat(F.lit(prefix + "/"), c)))
    return F.when((c == "") | c.rlike(LINK) | c.startswith("#"), c).otherwise(joined)


def utf8(c: Column) -> Column:
    """Binary content as text: as it is if valid, else with replacement characters."""
    return F.make_valid_utf8(c)


def _padded(key: Column, pad: int) -> Column:
    """A binary key of up to 64 bytes filled to 64, each byte xor ``pad``."""
    digits = F.rpad(F.hex(key), 128, "0")
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(pad))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def hmac_keys(secret: Column) -> tuple[Column, Column]:
    """Inner and outer key of HMAC-SHA256: to be made once for each secret, not for each message."""
    raw = secret.cast("binary")
    key = F.when(F.length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    return _padded(key, 0x36), _padded(key, 0x5C)


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 in hex, as deliveries carry it, from ``hmac_keys``."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def file_kind(content: Column) -> Column:
    """image, pdf, video, text or binary, by the first 1024 bytes; empty content is text."""
    head = F.hex(F.substring(content, 1, 1024))
    starts = lambda *digits: F.coalesce(*[F.when(head.startswith(d), True) for d in digits], F.lit(False))
    riff, kind = starts("52494646"), F.substring(head, 17, 8)
    image = starts("89504E470D0A1A0A", "FFD8FF", "47494638", "424D") | (riff & (kind == "57454250"))
    video = starts("1A45DFA3", "4F676753") | (F.substring(head, 9, 8) == "66747970") | (riff & (kind == "41564920"))
    odd = head.rlike("^(?:..)*+$") & F.exists(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda x: x.rlike("0[0-8E-F]|1[0-9AC-F]"))
    return F.when(image, "image").when(starts("255044462D"), "pdf").when(video, "video").when(odd, "binary").otherwise("text")


def random_text(n: int, seed: int | None = None) -> Column:
    """Random letters and digits (X45), new in each row; with a seed, the same in each run over the same partitions."""
    return F.randstr(F.lit(n), None if seed is None else F.lit(seed))
