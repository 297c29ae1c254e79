"""Joins (J1-J31): relations, batched lookups, semi and anti joins over the site's tables.

None broadcasts by hint: the planner does where statistics prove a side small, AQE re-plans
and splits skewed keys (a popular repository, a hot actor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeframe.operators.predicates import every


def organizations_of(users: DataFrame, org_user: DataFrame, uid: int, only_public: bool = False, only_owned: bool = False) -> DataFrame:
    """Organisations that a user belongs to (J1), owns."""
    rows = org_user.filter(every(F.col("uid") == uid, F.col("is_public") if only_public else None, F.col("is_owner") if only_owned else None))
    return users.join(rows.select(F.col("org_id").alias("id")), "id")


def teams_of(team: DataFrame, team_user: DataFrame, org_id: int, uid: int) -> DataFrame:
    return team.join(team_user.filter((F.col("org_id") == org_id) & (F.col("uid") == uid)).select(F.col("team_id").alias("id")), "id")


def teams_with_access(team: DataFrame, team_repo: DataFrame, repo_id: int, mode: int) -> DataFrame:
    return team.filter(F.col("authorize") >= mode).join(team_repo.filter(F.col("repo_id") == repo_id).select(F.col("team_id").alias("id")), "id")


def repos_shared_with(repos: DataFrame, access: DataFrame, uid: int, order: list[Column], limit: int, with_mode: bool = False) -> DataFrame:
    """Repositories that a user has read access to (J5), with the mode."""
    mine = access.filter((F.col("user_id") == uid) & (F.col("mode") >= 1)).select(F.col("repo_id").alias("id"), "mode")
    rows = repos.join(mine if with_mode else mine.select("id"), "id").orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows


def own_and_shared(repos: DataFrame, collaboration: DataFrame, uid: int) -> DataFrame:
    """Collaborative repositories and then one's own, duplicates kept."""
    shared = repos.join(collaboration.filter(F.col("user_id") == uid).select(F.col("repo_id").alias("id")), "id")
    return shared.unionByName(repos.filter(F.col("owner_id") == uid))


def owner_of_key(users: DataFrame, keys: DataFrame, key_id: int) -> DataFrame:
    return users.join(keys.filter(F.col("id") == key_id).select(F.col("owner_id").alias("id")), "id").limit(1)


def comments_since(comment: DataFrame, issue: DataFrame, repo_id: int, since: int) -> DataFrame:
    """Comments of a repository updated since."""
    mine = issue.filter(F.col("repo_id") == repo_id).select(F.col("id").alias("issue_id"))
    return comment.filter(F.col("updated_unix") >= since).join(mine, "issue_id")


def open_pulls(pulls: DataFrame, issue: DataFrame, **head) -> DataFrame:
    """Unmerged pull requests of open issues (J10), by equal columns."""
    rows = pulls.filter(every(~F.col("has_merged"), *[F.col(k) == v for k, v in head.items()]))
    return rows.join(issue.filter(~F.col("is_closed")).select(F.col("id").alias("issue_id")), "issue_id")


def with_labels(issue: DataFrame, issue_label: DataFrame, labels: list[int], distinct: bool = False) -> DataFrame:
    """Issues with any of the labels (J11): one row for each label they have, or each issue once."""
    hits = issue_label.filter(F.col("label_id").isin(labels)).select(F.col("issue_id").alias("id"))
    return issue.join(hits, "id", "left_semi" if distinct else "inner")


def mentioned(issue: DataFrame, issue_user: DataFrame, uid: int = 0) -> DataFrame:
    """Issues in which a user (anyone if 0) is mentioned."""
    hits = issue_user.filter(every(F.col("is_mentioned"), F.col("uid") == uid if uid > 0 else None))
    return issue.join(hits.select(F.col("issue_id").alias("id")), "id")


def linked_users(users: DataFrame, edges: DataFrame, user_column: str, where: Column, order: Column | None = None) -> DataFrame:
    """Users at the ends of edges: followers and followings by newest edge (J13), watchers and stargazers by id."""
    ends = edges.filter(where).select(F.col(user_column).alias("_uid"), F.col("id").alias("edge_id"))
    rows = users.join(ends, users["id"] == ends["_uid"]).drop("_uid")
    return rows.orderBy(F.desc("edge_id") if order is None else order)


def by_email(users: DataFrame, addresses: DataFrame, email: str) -> DataFrame:
    """The active individual with this primary, or activated secondary, address."""
    other = addresses.filter((F.lower("email") == email.lower()) & F.col("is_activated")).select(F.col("uid").alias("id"), F.lit(True).alias("_second")).distinct()
    primary = (F.lower("email") == email.lower()) & F.col("is_active")
    rows = users.filter(F.col("type") == 0).join(other, "id", "left").filter(primary | F.col("_second"))
    return rows.drop("_second").orderBy("id").limit(1)


def visible_repos(repos: DataFrame, access: DataFrame, uid: int, private: bool = False) -> DataFrame:
    """Repositories that a user may find (F5, J16): a semi join in place of a left join and DISTINCT, so none repeats."""
    from forgeframe.operators.predicates import open_parts, public

    if private:
        return repos
    if uid <= 0:
        return repos.filter(public() | open_parts())
    mine = access.filter(F.col("user_id") == uid).select(F.col("repo_id").alias("id"), F.lit(True).alias("_mine")).distinct()
    rows = repos.join(mine, "id", "left")
    return rows.filter((F.col("owner_id") == uid) | F.col("_mine") | public() | open_parts()).drop("_mine")


def organization_feed(actions: DataFrame, repos: DataFrame, team_repo: DataFrame, team_user: DataFrame, org_id: int, actor: int) -> DataFrame:
    """Actions received by an organisation on repositories of the actor's teams, or public ones that some team has."""
    teams = team_user.filter((F.col("org_id") == org_id) & (F.col("uid") == actor)).select("team_id", F.lit(True).alias("_member")).distinct()
    linked = team_repo.select("team_id", F.col("repo_id").alias("id")).join(teams, "team_id", "left")
    from forgeframe.operators.predicates import public

    seen = repos.join(linked, "id").filter(F.col("_member") | public()).select(F.col("id").alias("repo_id"))
    return actions.filter(F.col("user_id") == org_id).join(seen, "repo_id", "left_semi")


def attach(rows: DataFrame, key: str, other: DataFrame, other_key: str, prefix: str) -> DataFrame:
    """Batched lookup (J19): a left join with prefixed columns; a missing row gives nulls. ``other_key`` is unique."""
    named = other.select(*[F.col(c).alias(f"{prefix}{c}") for c in other.columns])
    return rows.join(named, F.col(key) == F.col(f"{prefix}{other_key}"), "left")


GHOST_ID, GHOST_NAME = -1, "Ghost"


def with_poster(rows: DataFrame, users: DataFrame, key: str = "poster_id") -> DataFrame:
    """poster_name and poster_id; a poster who is gone becomes the ghost."""
    named = users.select(F.col("id").alias("_uid"), F.col("name").alias("poster_name"))
    found = rows.join(named, F.col(key) == F.col("_uid"), "left")
    return found.withColumns({key: F.coalesce("_uid", F.lit(GHOST_ID)), "poster_name": F.coalesce("poster_name", F.lit(GHOST_NAME))}).drop("_uid")


def nested(parent: DataFrame, child: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """Children as a sorted array of structs under each parent (J20, A14); none: an empty array."""
    grouped = child.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = parent.join(grouped, F.col("id") == F.col("_key"), "left").drop("_key")
    return rows.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def commits_with_users(commits: DataFrame, users: DataFrame, email: str = "author_email") -> DataFrame:
    """user_id of each commit's author by e-mail without regard to case; null if unknown."""
    mail = users.groupBy(F.lower("email").alias("_mail")).agg(F.min("id").alias("user_id"))
    return commits.join(mail, F.lower(email) == F.col("_mail"), "left").drop("_mail")


def feed_with_actors(page: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of a page whose actor exists, by name (J22): joined after the limit, so a page may be short."""
    actors = users.select(F.col("name").alias("act_user_name"), F.col("email").alias("act_email"))
    return page.join(actors, "act_user_name")


def flagged(rows: DataFrame, key: str, other: DataFrame, other_key: str, flag: str) -> DataFrame:
    """A boolean column: whether the key exists in ``other``."""
    hits = other.select(F.col(other_key).alias("_key")).distinct()
    return rows.join(hits, F.col(key) == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def tags_with_releases(tags: DataFrame, releases: DataFrame) -> DataFrame:
    """Every tag with its first release, or one made up from the tag."""
    first = releases.groupBy("tag_name").agg(F.min_by(F.struct("id", "title", "is_prerelease"), "id").alias("r"))
    rows = tags.join(first, "tag_name", "left")
    return rows.select("tag_name", F.coalesce("r.id", F.lit(0)).alias("release_id"), F.coalesce("r.title", "tag_name").alias("title"), F.coalesce("r.is_prerelease", F.lit(False)).alias("is_prerelease"))


def read_flags(issue: DataFrame, issue_user: DataFrame, uid: int) -> DataFrame:
    """is_read of each issue for a user (0: any); without a record it counts as read."""
    mine = issue_user.filter(F.col("uid") == uid) if uid else issue_user
    flags = mine.groupBy(F.col("issue_id").alias("id")).agg(F.max("is_read").alias("is_read"))
    return issue.join(flags, "id", "left").withColumn("is_read", F.coalesce("is_read", F.lit(True)))


def missing(rows: DataFrame, key: str, present: DataFrame, present_key: str) -> DataFrame:
    """Rows whose key isn't present, such as repositories without a folder."""
    return rows.join(present.select(F.col(present_key).alias(key)), key, "left_anti")


def not_named(names: DataFrame, told: DataFrame, column: str = "name") -> DataFrame:
    """Names that nobody told has, without regard to case."""
    known = told.select(F.lower(column).alias("_low"))
    return names.join(known, F.lower(names[column]) == F.col("_low"), "left_anti")


def blob_batch(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested blobs (oid, size) with what to answer: 404 missing, 422 other size, 200 found."""
    have = stored.select("oid", F.col("size").alias("_size"))
    code = F.when(F.col("_size").isNull(), 404).when(F.col("_size") != F.col("size"), 422).otherwise(200)
    return wanted.join(have, "oid", "left").withColumn("code", code).drop("_size")


def allowed_ids(branches: DataFrame, csv: str, allowed: DataFrame, key: str) -> DataFrame:
    """A list of ids as text, reduced to those allowed for the branch's repository, in numeric order."""
    ids = branches.select("id", "repo_id", F.explode(F.split(csv, ",")).alias("_t")).select("id", "repo_id", F.expr("try_cast(trim(_t) as bigint)").alias(key))
    kept = ids.join(allowed.select("repo_id", key), ["repo_id", key], "left_semi")
    joined = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: x.cast("string")), ",").alias(csv))
    return branches.drop(csv).join(joined, "id", "left").withColumn(csv, F.coalesce(csv, F.lit("")))


def without_members(collaboration: DataFrame, org_user: DataFrame, new_owner: int) -> DataFrame:
    """Collaborators left after a transfer: not the new owner, not members of it."""
    inside = org_user.filter(F.col("org_id") == new_owner).select(F.col("uid").alias("user_id"))
    return collaboration.filter(F.col("user_id") != new_owner).join(inside, "user_id", "left_anti")
