"""Counts, counters and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeframe.operators.predicates import every


def count(df: DataFrame, *conditions: Column | None) -> DataFrame:
    return df.filter(every(*conditions)).agg(F.count(F.lit(1)).alias("n"))


def open_closed(df: DataFrame, *keys: str) -> DataFrame:
    """n_open and n_closed in one pass (A3, A5), for each key if there are any."""
    return df.groupBy(*keys).agg(F.count_if(~F.col("is_closed")).alias("n_open"), F.count_if("is_closed").alias("n_closed"))


def dashboard(issue: DataFrame, uid: int, repo_ids: list[int], is_pull: bool, mode: str) -> DataFrame:
    """A user's counters (A4) in one scan: assigned, created, in own repositories, and open and closed of the filter mode."""
    own = F.col("repo_id").isin(repo_ids) if repo_ids else F.lit(False)
    still_open = ~F.col("is_closed")
    chosen = {"assigned": F.col("assignee_id") == uid, "created": F.col("poster_id") == uid, "your": own}[mode]
    return issue.filter(F.col("is_pull") == is_pull).agg(
        F.count_if((F.col("assignee_id") == uid) & still_open).alias("assign_count"),
        F.count_if((F.col("poster_id") == uid) & still_open).alias("create_count"),
        F.count_if(own & still_open).alias("your_count"),
        F.count_if(chosen & still_open).alias("open_count"),
        F.count_if(chosen & F.col("is_closed")).alias("closed_count"),
    )


def drift(owner: DataFrame, counter: str, rows: DataFrame, key: str) -> DataFrame:
    """(id, stored, actual) of rows whose stored counter is wrong (A6); owners without rows count zero."""
    actual = rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("actual"))
    found = owner.select("id", F.col(counter).alias("stored")).join(actual, "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return found.filter(F.col("stored") != F.col("actual"))


def recounted(owner: DataFrame, counter: str, rows: DataFrame, key: str) -> DataFrame:
    """``owner`` with the counter set to the count of its rows (A7), which incremental updates (A8) must equal."""
    actual = rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return owner.join(actual, "id", "left").withColumn(counter, F.coalesce("_n", F.lit(0))).drop("_n").select(*owner.columns)


def team_grants(team: DataFrame, team_user: DataFrame, team_repo: DataFrame, repos: DataFrame, without_team: int = 0) -> tuple[DataFrame, DataFrame]:
    """Members (team_id, user_id), each once, and grants (team_id, repo_id, mode).

    The team "owners" grants ownership of all its organisation's repositories, other teams their own mode on their repositories.
    """
    teams = team.filter(F.col("id") != without_team).select(F.col("id").alias("team_id"), "org_id", "lower_name", "authorize")
    people = team_user.select("team_id", F.col("uid").alias("user_id")).distinct()
    teams = teams.join(people.select("team_id"), "team_id", "left_semi")
    owners = teams.filter(F.col("lower_name") == "owners").join(repos.select(F.col("id").alias("repo_id"), F.col("owner_id").alias("org_id")), "org_id").select("team_id", "repo_id", F.lit(4).cast("bigint").alias("mode"))
    others = teams.filter(F.col("lower_name") != "owners").join(team_repo.select("team_id", "repo_id"), "team_id").select("team_id", "repo_id", F.col("authorize").alias("mode"))
    return people, owners.unionByName(others)


def access_modes(collaboration: DataFrame, team: DataFrame, team_user: DataFrame, team_repo: DataFrame, repos: DataFrame, without_team: int = 0) -> DataFrame:
    """(user_id, repo_id, mode): the highest of collaboration and team grants."""
    people, granted = team_grants(team, team_user, team_repo, repos, without_team)
    grants = granted.join(people, "team_id").select("user_id", "repo_id", "mode")
    return collaboration.select("user_id", "repo_id", "mode").unionByName(grants).groupBy("user_id", "repo_id").agg(F.max("mode").alias("mode"))


def access_totals(collaboration: DataFrame, team: DataFrame, team_user: DataFrame, team_repo: DataFrame, repos: DataFrame, without_team: int = 0) -> DataFrame:
    """(mode, n, u, r): of each mode of ``access_modes`` the number of its rows and the sums of their user_id and repo_id.

    Members of the same teams have the same grants, and so have repositories with the same ones. Such users and
    repositories are one class each, a mode is found for each pair of classes that share a team, and it counts for all
    their pairs; no row is made for a user and repository but those of ``collaboration``, which then move to their own mode.
    """
    people, granted = team_grants(team, team_user, team_repo, repos, without_team)
    granted = granted.groupBy("team_id", "repo_id").agg(F.max("mode").alias("mode"))
    member = people.join(granted.select("team_id"), "team_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_set("team_id")).alias("teams"))
    held = granted.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.struct("team_id", "mode"))).alias("grants"))
    users = member.groupBy("teams").agg(F.count("*").alias("users"), F.sum("user_id").alias("user_ids"))
    kinds = held.groupBy("grants").agg(F.count("*").alias("repos"), F.sum("repo_id").alias("repo_ids"))
    shared = users.withColumn("team_id", F.explode("teams")).join(kinds.select("*", F.explode("grants").alias("g")).select("*", "g.team_id", "g.mode").drop("g"), "team_id")
    shared = shared.groupBy("teams", "grants", "users", "user_ids", "repos", "repo_ids").agg(F.max("mode").alias("mode"))
    whole = shared.select("mode", (F.col("users") * F.col("repos")).alias("n"), (F.col("user_ids") * F.col("repos")).alias("u"), (F.col("repo_ids") * F.col("users")).alias("r"))
    own = collaboration.groupBy("user_id", "repo_id").agg(F.max("mode").alias("own"))
    own = own.join(member.withColumnRenamed("user_id", "_user"), F.col("user_id").eqNullSafe(F.col("_user")), "left").join(held.withColumnRenamed("repo_id", "_repo"), F.col("repo_id").eqNullSafe(F.col("_repo")), "left")
    own = own.join(shared.select("teams", "grants", F.col("mode").alias("given"), F.lit(True).alias("has")), ["teams", "grants"], "left")
    best = F.greatest("own", "given")
    row = lambda mode, sign: F.struct(mode.alias("mode"), F.lit(sign).cast("bigint").alias("n"), (F.col("user_id") * sign).cast("bigint").alias("u"), (F.col("repo_id") * sign).cast("bigint").alias("r"))
    moves = F.when(F.col("has"), F.when(best.eqNullSafe(F.col("given")), F.array()).otherwise(F.array(row(best, 1), row(F.col("given"), -1)))).otherwise(F.array(row(best, 1)))
    moved = own.select(F.explode(moves).alias("m")).select("m.*")
    return whole.unionByName(moved).groupBy("mode").agg(*[F.sum(c).alias(c) for c in "nur"]).filter("n > 0")


def effective_access(asked: DataFrame, repos: DataFrame, access: DataFrame) -> DataFrame:
    """(user_id, repo_id) with mode (A10): owner, else the access row, else read if public, else none."""
    rows = asked.join(repos.select(F.col("id").alias("repo_id"), "owner_id", "is_private"), "repo_id", "left")
    rows = rows.join(access.select("user_id", "repo_id", F.col("mode").alias("_mode")), ["user_id", "repo_id"], "left")
    base = F.when(F.col("is_private") == F.lit(False), 1).otherwise(0)
    mode = F.when((F.col("user_id") <= 0) | F.col("owner_id").isNull(), base).when(F.col("user_id") == F.col("owner_id"), 4).otherwise(F.coalesce("_mode", base))
    return rows.select("user_id", "repo_id", mode.cast("bigint").alias("mode"))


def authorized(modes: DataFrame, desired: int) -> DataFrame:
    return modes.withColumn("allowed", F.col("mode") >= desired)


def commits_behind(releases: DataFrame, branches: DataFrame) -> DataFrame:
    """Commits that a release is behind its target branch (A12), never below zero."""
    heads = branches.select(F.col("name").alias("target"), F.col("num_commits").alias("_head"))
    return releases.join(heads, "target", "left").withColumn("behind", F.greatest(F.coalesce(F.col("_head") - F.col("num_commits"), F.lit(0)), F.lit(0))).drop("_head")


def recipients(watchers: DataFrame, participants: DataFrame, assignee: DataFrame, users: DataFrame, doer: int) -> DataFrame:
    """(issue_id, name, email) of whom to mail about each issue.

    Watchers who are active individuals, participants, the assignee, in this order, the first
    of each name without regard to case; never the doer. Inputs: (issue_id, user_id).
    """
    ranked = [df.select("issue_id", "user_id", F.lit(i).alias("rank")) for i, df in enumerate((watchers, participants, assignee))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).filter(F.col("user_id") != doer)
    rows = rows.join(users.select(F.col("id").alias("user_id"), "name", "email", "type", "is_active"), "user_id")
    rows = rows.filter((F.col("rank") > 0) | ((F.col("type") == 0) & F.col("is_active")))
    first = F.min_by(F.struct("name", "email"), F.struct("rank", "user_id")).alias("r")
    return rows.groupBy("issue_id", F.lower("name").alias("_low")).agg(first).select("issue_id", "r.name", "r.email")


def recipient_parts(issues: DataFrame, watch: DataFrame, participants: DataFrame, assignee: DataFrame, users: DataFrame, doer: int) -> tuple[DataFrame, DataFrame]:
    """Who is told of every issue of a repository (repo_id, r) and who else of one issue (issue_id, r); r: name, email.

    Watchers come first and are the same for all issues of a repository, so names are made distinct by
    repository; what is grouped never holds a row for each issue and watcher.
    """
    people = users.select(F.col("id").alias("user_id"), "name", "email", F.lower("name").alias("_low"), ((F.col("type") == 0) & F.col("is_active")).alias("_reads"))
    first = F.min_by(F.struct("name", "email"), F.struct("rank", "user_id")).alias("r")
    seen = watch.select("repo_id", "user_id", F.lit(0).alias("rank")).distinct().filter(F.col("user_id") != doer).join(people.filter("_reads"), "user_id")
    seen = seen.groupBy("repo_id", "_low").agg(first)
    more = participants.select("issue_id", "user_id", F.lit(1).alias("rank")).unionByName(assignee.select("issue_id", "user_id", F.lit(2).alias("rank")))
    more = more.filter(F.col("user_id") != doer).join(people, "user_id").groupBy("issue_id", "_low").agg(first)
    more = more.join(issues, "issue_id").join(seen.select("repo_id", "_low"), ["repo_id", "_low"], "left_anti")
    return seen.select("repo_id", "r"), more.select("issue_id", "r")


def issue_recipients(issues: DataFrame, watch: DataFrame, participants: DataFrame, assignee: DataFrame, users: DataFrame, doer: int) -> DataFrame:
    """As ``recipients``, from issues (issue_id, repo_id) and watch (repo_id, user_id)."""
    seen, more = recipient_parts(issues, watch, participants, assignee, users, doer)
    return issues.join(seen, "repo_id").select("issue_id", "r.name", "r.email").unionByName(more.select("issue_id", "r.name", "r.email"))


def recipient_totals(issues: DataFrame, watch: DataFrame, participants: DataFrame, assignee: DataFrame, users: DataFrame, doer: int) -> DataFrame:
    """(issue_id, n, first, last): of each issue with ``issue_recipients`` their number, least name and greatest email.

    Both parts are summed up where they are, by repository and by issue, so no row is made for an issue and watcher.
    """
    seen, more = recipient_parts(issues, watch, participants, assignee, users, doer)
    totals = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n"), F.min("r.name").alias("first"), F.max("r.email").alias("last"))
    both = issues.select("issue_id", "repo_id").join(totals(seen, "repo_id"), "repo_id").drop("repo_id").unionByName(totals(more, "issue_id"))
    return both.groupBy("issue_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
