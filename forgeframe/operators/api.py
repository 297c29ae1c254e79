"""API projections (F19, F21): site rows as nested columns, ready for ``to_json``.

Every function takes the frame and keeps one row for each of its rows; joined objects come from
left joins on unique keys, so a missing one is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeframe.functions import text as T
from forgeframe.operators.predicates import EVENTS_DDL, subscriptions

USER = ("id", "name", "full_name", "email")


def user(prefix: str = "", signed_in: bool = True) -> Column:
    """A user's object from the columns of ``USER`` with a prefix; null if the id is."""
    c = lambda n: F.col(prefix + n)
    email = c("email") if signed_in else F.lit("")
    made = F.struct(c("id").alias("id"), c("name").alias("username"), c("name").alias("login"), c("full_name").alias("full_name"), email.alias("email"), T.avatar(c("email")).alias("avatar_url"))
    return F.when(c("id").isNotNull(), made)


def with_user(rows: DataFrame, key: str, users: DataFrame, name: str, signed_in: bool = True) -> DataFrame:
    """A column ``name`` with the object of the user that ``key`` points to."""
    named = users.select(*[F.col(c).alias(f"_{name}_{c}") for c in USER])
    joined = rows.join(named, F.col(key) == F.col(f"_{name}_id"), "left")
    return joined.withColumn(name, user(f"_{name}_", signed_in)).drop(*[f"_{name}_{c}" for c in USER])


def state(closed: Column) -> Column:
    return F.when(closed, "closed").otherwise("open")


def emails(rows: DataFrame) -> DataFrame:
    return rows.select("email", F.col("is_activated").alias("verified"), F.col("is_primary").alias("primary"))


def organizations(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("name").alias("username"), "full_name", T.avatar(F.col("email")).alias("avatar_url"), "description", "website", "location")


def teams(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "description", T.mode_name(F.col("authorize")).alias("permission"))


def labels(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", F.regexp_replace("color", "^#+", "").alias("color"))


def milestones(rows: DataFrame) -> DataFrame:
    """The deadline is left out if it is in the year 9999, the closing time if the milestone is open."""
    at = lambda c: F.timestamp_seconds(F.col(c))
    return rows.select(
        "id", F.col("name").alias("title"), F.col("content").alias("description"), state(F.col("is_closed")).alias("state"),
        (F.col("num_issues") - F.col("num_closed_issues")).alias("open_issues"), F.col("num_closed_issues").alias("closed_issues"),
        F.when(F.col("is_closed"), at("closed_date_unix")).alias("closed_at"), F.when(F.year(at("deadline_unix")) < 9999, at("deadline_unix")).alias("due_on"),
    )


def issues(rows: DataFrame, users: DataFrame, issue_label: DataFrame, label: DataFrame, pulls: DataFrame) -> DataFrame:
    """Issues with poster, assignee, sorted labels and, for pull requests, whether they are merged."""
    own = issue_label.join(labels(label).select(F.col("id").alias("label_id"), "name", "color"), "label_id")
    grouped = own.groupBy(F.col("issue_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("label_id").alias("id"), "name", "color"))).alias("labels"))
    merged = pulls.groupBy(F.col("issue_id").alias("_pid")).agg(F.max("has_merged").alias("_merged"))
    out = rows.join(grouped, F.col("id") == F.col("_id"), "left").join(merged, F.col("id") == F.col("_pid"), "left")
    out = with_user(with_user(out, "poster_id", users, "user"), "assignee_id", users, "assignee")
    pull = F.when(F.col("is_pull"), F.struct(F.coalesce("_merged", F.lit(False)).alias("merged")))
    none = F.array().cast(grouped.schema["labels"].dataType)
    return out.select("id", F.col("index").alias("number"), "user", F.col("name").alias("title"), F.coalesce("labels", none).alias("labels"), "assignee", state(F.col("is_closed")).alias("state"), F.col("num_comments").alias("comments"), pull.alias("pull_request"))


def comments(rows: DataFrame, users: DataFrame) -> DataFrame:
    return with_user(rows, "poster_id", users, "user").select("id", "user", F.col("content").alias("body"), F.timestamp_seconds("updated_unix").alias("updated_at"))


def releases(rows: DataFrame, users: DataFrame) -> DataFrame:
    out = with_user(rows, "publisher_id", users, "author")
    return out.select("id", "tag_name", F.col("target").alias("target_commitish"), F.col("title").alias("name"), F.col("is_draft").alias("draft"), F.col("is_prerelease").alias("prerelease"), "author")


def permissions(mode: Column) -> Column:
    return F.struct((mode >= 3).alias("admin"), (mode >= 2).alias("push"), (mode >= 1).alias("pull"))


def collaborators(rows: DataFrame, users: DataFrame) -> DataFrame:
    return with_user(rows, "user_id", users, "user").select("user", permissions(F.col("mode")).alias("permissions"))


def repositories(rows: DataFrame, users: DataFrame, site: str, mode: Column | None = None) -> DataFrame:
    """Repositories with owner, links and counters; ``mode``: the caller's access."""
    out = with_user(rows, "owner_id", users, "owner")
    full = F.concat_ws("/", "owner.username", "name")
    open_issues = F.greatest(F.coalesce(F.col("num_issues"), F.lit(0)) - F.coalesce(F.col("num_closed_issues"), F.lit(0)), F.lit(0)) if "num_issues" in rows.columns else F.lit(0)
    return out.select(
        "id", "owner", "name", full.alias("full_name"), "description", F.col("is_private").alias("private"), F.col("is_fork").alias("fork"),
        F.col("is_mirror").alias("mirror"), "size", F.concat(F.lit(site), full).alias("html_url"), F.concat(F.lit(site), full, F.lit(".git")).alias("clone_url"),
        F.col("num_stars").alias("stars_count"), F.col("num_watches").alias("watchers_count"), open_issues.alias("open_issues_count"),
        permissions(F.lit(1) if mode is None else mode).alias("permissions"),
    )


def hooks(rows: DataFrame, repo_link: str, settings: str = "events") -> DataFrame:
    parsed = F.from_json(settings, EVENTS_DDL)
    return rows.select("id", F.concat(F.lit(f"{repo_link}/settings/hooks/"), F.col("id").cast("string")).alias("url"), F.col("is_active").alias("active"), F.create_map(F.lit("url"), F.col("url")).alias("config"), subscriptions(parsed).alias("events"))


def keys(rows: DataFrame, link: str, deploy: bool = False) -> DataFrame:
    out = rows.select("id", F.col("content").alias("key"), F.concat(F.lit(link), F.col("id").cast("string")).alias("url"), F.col("name").alias("title"))
    return out.withColumn("read_only", F.lit(True)) if deploy else out


def commits(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Commits with the names of the users who have their author's and committer's addresses, else empty."""
    out = rows
    for who in ("author", "committer"):
        known = users.groupBy(F.lower("email").alias("_mail")).agg(F.min_by("name", "id").alias(f"{who}_username"))
        out = out.join(known, F.lower(f"{who}_email") == F.col("_mail"), "left").drop("_mail").fillna("", [f"{who}_username"])
    person = lambda who: F.struct(F.col(f"{who}_name").alias("name"), F.col(f"{who}_email").alias("email"), F.col(f"{who}_username").alias("username"))
    return out.select(F.col("sha").alias("id"), "message", person("author").alias("author"), person("committer").alias("committer"))


def heads(rows: DataFrame, commits_: DataFrame) -> DataFrame:
    """Branches or tags (name, sha) with their commits."""
    return rows.join(commits_.select(F.col("id").alias("sha"), F.struct("*").alias("commit")), "sha", "left").select("name", "commit")


