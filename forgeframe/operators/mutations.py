"""Mutations as functions from DataFrames to DataFrames.

Counters are never changed by ±1: after a change they are recounted from the rows, so a rerun
gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forgeframe.operators.aggregates import access_modes, recounted


CELLS = 4096


def numbered(rows: DataFrame, column: str, start, *order: str) -> DataFrame:
    """Rows with ``column``: gapless numbers after ``start``, in the order of hash cells.

    Rows are numbered inside cells and cells get offsets from a table of at most ``CELLS`` counts, so
    no task holds all rows. Reruns give the same numbers, whichever of several equal rows gets which.
    """
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(CELLS)))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_cell", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.row_number().over(W.partitionBy("_cell").orderBy(*order))
    out = rows.withColumn("_place", place).join(F.broadcast(offsets), "_cell")
    return out.withColumn(column, (start + F.col("_ahead") + F.col("_place")).cast("bigint")).drop("_cell", "_place", "_ahead")


def add_edges(edges: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Edges with those of ``new`` that aren't there yet (M1); ids go on from the highest."""
    fresh = new.select(*keys).distinct().join(edges.select(*keys), list(keys), "left_anti")
    top = edges.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    return edges.unionByName(numbered(fresh, "id", top, *keys).select("id", *keys), allowMissingColumns=True)


def remove_edges(edges: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Edges without those of ``gone`` (M2)."""
    return edges.join(gone.select(*keys), list(keys), "left_anti")


def replace_rows(table: DataFrame, key: Column, new: DataFrame) -> DataFrame:
    """All rows of a key replaced (M3)."""
    return table.filter(~F.coalesce(key, F.lit(False))).unionByName(new, allowMissingColumns=True)


#: Tables and the columns by which a user's rows go.
USER_ROWS = {"watch": "user_id", "star": "uid", "follow": ("user_id", "follow_id"), "access": "user_id", "action": "user_id", "access_token": "uid", "collaboration": "user_id", "email_address": "uid", "issue_user": "uid", "public_key": "owner_id", "two_factor": "user_id", "two_factor_recovery_code": "user_id"}


def deletable_users(users: DataFrame, repos: DataFrame, org_user: DataFrame) -> DataFrame:
    """Users who own no repository and belong to no organisation (M4's precondition)."""
    left = users.join(repos.select(F.col("owner_id").alias("id")), "id", "left_anti")
    return left.join(org_user.select(F.col("uid").alias("id")), "id", "left_anti")


def without_rows(tables: dict[str, DataFrame], where: dict[str, str | tuple], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows whose column (any of a tuple) is an id of ``gone`` (column id)."""
    out = dict(tables)
    for name, columns in where.items():
        if name in out:
            for c in (columns,) if isinstance(columns, str) else columns:
                out[name] = out[name].join(gone.select(F.col("id").alias("_gone")), F.col(c) == F.col("_gone"), "left_anti")
    return out


def delete_users(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting users (M4): their rows go, assignments are cleared, counters recounted."""
    gone = deletable_users(tables["user"], tables["repository"], tables["org_user"]).join(gone.select("id"), "id", "left_semi")
    out = without_rows(tables, USER_ROWS | {"user": "id"}, gone)
    if "issue" in out:
        cleared = gone.select(F.col("id").alias("assignee_id"), F.lit(True).alias("_gone"))
        out["issue"] = out["issue"].join(cleared, "assignee_id", "left").withColumn("assignee_id", F.when(F.col("_gone"), 0).otherwise(F.col("assignee_id"))).select(*out["issue"].columns)
    return out | counters(out)


def counters(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """user and repository with followers, followings, stars and watches recounted."""
    user, repository = tables["user"], tables["repository"]
    user = recounted(user, "num_followers", tables["follow"], "follow_id")
    user = recounted(user, "num_following", tables["follow"], "user_id")
    user = recounted(user, "num_stars", tables["star"], "uid")
    user = recounted(user, "num_repos", repository, "owner_id")
    repository = recounted(repository, "num_stars", tables["star"], "repo_id")
    return {"user": user, "repository": recounted(repository, "num_watches", tables["watch"], "repo_id")}


#: Tables and the column by which a repository's rows go.
REPO_ROWS = {"access": "repo_id", "action": "repo_id", "collaboration": "repo_id", "deploy_key": "repo_id", "watch": "repo_id", "star": "repo_id", "issue_user": "repo_id", "label": "repo_id", "milestone": "repo_id", "mirror": "repo_id", "release": "repo_id", "webhook": "repo_id", "hook_task": "repo_id", "pull_request": "base_repo_id", "protect_branch": "repo_id", "protect_branch_whitelist": "repo_id", "team_repo": "repo_id"}


def delete_repos(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting repositories (M5): their rows, their issues' rows, and forks stand alone."""
    out = without_rows(tables, REPO_ROWS, gone)
    lost = tables["issue"].join(gone.select(F.col("id").alias("repo_id")), "repo_id", "left_semi").select("id")
    out = without_rows(out, {"comment": "issue_id", "attachment": "issue_id", "issue_label": "issue_id"}, lost)
    out = without_rows(out, {"issue": "repo_id", "repository": "id"}, gone)
    forks = gone.select(F.col("id").alias("fork_id"), F.lit(True).alias("_gone"))
    alone = out["repository"].join(forks, "fork_id", "left")
    orphan = F.coalesce("_gone", F.lit(False))
    out["repository"] = alone.withColumns({"is_fork": F.col("is_fork") & ~orphan, "fork_id": F.when(orphan, 0).otherwise(F.col("fork_id"))}).select(*out["repository"].columns)
    return out | counters(out)


def delete_organizations(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting organisations that own no repository (M6)."""
    gone = gone.select("id").join(tables["repository"].select(F.col("owner_id").alias("id")), "id", "left_anti")
    return without_rows(tables, {"team": "org_id", "org_user": "org_id", "team_user": "org_id", "team_repo": "org_id", "user": "id"}, gone)


def leave_organization(tables: dict[str, DataFrame], org_id: int, uid: int) -> dict[str, DataFrame]:
    """Tables after a member left: membership, team memberships, access and watches of its repositories (M6)."""
    repos = tables["repository"].filter(F.col("owner_id") == org_id).select(F.col("id").alias("repo_id"))
    out = dict(tables)
    out["org_user"] = tables["org_user"].filter(~((F.col("org_id") == org_id) & (F.col("uid") == uid)))
    out["team_user"] = tables["team_user"].filter(~((F.col("org_id") == org_id) & (F.col("uid") == uid)))
    for name in ("access", "watch"):
        mine = repos.withColumn("user_id", F.lit(uid).cast("bigint"))
        out[name] = tables[name].join(mine, ["repo_id", "user_id"], "left_anti")
    return out


def delete_team(tables: dict[str, DataFrame], team_id: int) -> dict[str, DataFrame]:
    """Tables after deleting a team: its rows, and access recomputed without it."""
    out = dict(tables)
    out["team"] = tables["team"].filter(F.col("id") != team_id)
    for name in ("team_user", "team_repo"):
        out[name] = tables[name].filter(F.col("team_id") != team_id)
    out["access"] = access_modes(tables["collaboration"], out["team"], out["team_user"], out["team_repo"], tables["repository"])
    return out


def rename_user(tables: dict[str, DataFrame], uid: int, name: str) -> dict[str, DataFrame]:
    """User, feed rows and pull requests after a rename (M7); references stay if only the case changes."""
    old = tables["user"].filter(F.col("id") == uid).select(F.col("lower_name").alias("_old"))
    out = dict(tables)
    me = F.col("id") == uid
    out["user"] = tables["user"].withColumns({"name": F.when(me, name).otherwise(F.col("name")), "lower_name": F.when(me, name.lower()).otherwise(F.col("lower_name"))})
    for table, column in (("action", "act_user_name"), ("action", "repo_user_name"), ("pull_request", "head_user_name")):
        if table in out and column in out[table].columns:
            rows = out[table].join(old.filter(F.col("_old") != name.lower()), F.lower(column) == F.col("_old"), "left")
            out[table] = rows.withColumn(column, F.when(F.col("_old").isNotNull(), name).otherwise(F.col(column))).drop("_old")
    return out


def transfer_repo(tables: dict[str, DataFrame], repo_id: int, new_owner: int) -> dict[str, DataFrame]:
    """Tables after a change of owner (M8): owner, collaborators, team links, access, counters."""
    from forgeframe.operators.joins import without_members

    out = dict(tables)
    here = F.col("repo_id") == repo_id
    out["repository"] = tables["repository"].withColumn("owner_id", F.when(F.col("id") == repo_id, new_owner).otherwise(F.col("owner_id")).cast("bigint"))
    kept = without_members(tables["collaboration"].filter(here), tables["org_user"], new_owner)
    out["collaboration"] = replace_rows(tables["collaboration"], here, kept)
    out["team_repo"] = tables["team_repo"].filter(~here)
    modes = access_modes(out["collaboration"].filter(here), tables["team"], tables["team_user"], out["team_repo"], out["repository"].filter(F.col("id") == repo_id))
    out["access"] = replace_rows(tables["access"], here, modes)
    out["user"] = recounted(tables["user"], "num_repos", out["repository"], "owner_id")
    return out


def create_issues(issue: DataFrame, new: DataFrame, milestone: DataFrame, access: DataFrame) -> DataFrame:
    """Issues with new ones (repo_id, poster_id, name, milestone_id, assignee_id) (M9).

    Indexes go on from each repository's highest, so they never collide; a milestone of another
    repository and an assignee without write access are dropped.
    """
    top = issue.groupBy("repo_id").agg(F.max("index").alias("_index"))
    last = issue.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    rows = new.join(milestone.select(F.col("id").alias("milestone_id"), "repo_id", F.lit(True).alias("_m")), ["milestone_id", "repo_id"], "left")
    writers = access.filter("mode >= 2").select(F.col("user_id").alias("assignee_id"), "repo_id", F.lit(True).alias("_a"))
    rows = rows.join(writers, ["assignee_id", "repo_id"], "left").join(top, "repo_id", "left")
    order = ["repo_id", "poster_id", "name"]
    rows = rows.withColumns({
        "index": F.coalesce("_index", F.lit(0)) + F.row_number().over(W.partitionBy("repo_id").orderBy(*order)),
        "milestone_id": F.when(F.col("_m"), F.col("milestone_id")).otherwise(0).cast("bigint"),
        "assignee_id": F.when(F.col("_a"), F.col("assignee_id")).otherwise(0).cast("bigint"),
        "is_closed": F.lit(False), "is_pull": F.lit(False), "num_comments": F.lit(0).cast("bigint"),
    })
    return issue.unionByName(numbered(rows.drop("_m", "_a", "_index"), "id", last, *order), allowMissingColumns=True)


def change_status(tables: dict[str, DataFrame], issues: DataFrame, closed: bool) -> dict[str, DataFrame]:
    """Issues closed or reopened, and the counters of labels, milestones and repositories."""
    out = dict(tables)
    hit = issues.select("id", F.lit(True).alias("_hit")).distinct()
    out["issue"] = tables["issue"].join(hit, "id", "left").withColumn("is_closed", F.when(F.col("_hit"), closed).otherwise(F.col("is_closed"))).drop("_hit").select(*tables["issue"].columns)
    shut = out["issue"].filter("is_closed")
    if "label" in out:
        out["label"] = recounted(out["label"], "num_closed_issues", tables["issue_label"].join(shut.select(F.col("id").alias("issue_id")), "issue_id"), "label_id")
    if "milestone" in out:
        m = recounted(recounted(out["milestone"], "num_closed_issues", shut, "milestone_id"), "num_issues", out["issue"], "milestone_id")
        out["milestone"] = m.withColumn("completeness", completeness())
    if "repository" in out:
        out["repository"] = recounted(out["repository"], "num_closed_issues", shut.filter("not is_pull"), "repo_id")
    return out


def completeness() -> Column:
    """Closed share of a milestone in whole per cent; 0 without issues."""
    return F.when(F.col("num_issues") > 0, F.expr("num_closed_issues * 100 div num_issues")).otherwise(0).cast("bigint")


def mention_users(issue_user: DataFrame, mentioned: DataFrame) -> DataFrame:
    """issue_user with ``is_mentioned`` set for (issue_id, uid), rows added where there are none."""
    hit = mentioned.select("issue_id", "uid", F.lit(True).alias("is_mentioned")).distinct()
    old = issue_user.join(hit.withColumnRenamed("is_mentioned", "_m"), ["issue_id", "uid"], "left")
    old = old.withColumn("is_mentioned", F.coalesce(F.col("is_mentioned") | F.col("_m"), F.col("is_mentioned"))).select(*issue_user.columns)
    return old.unionByName(hit.join(issue_user.select("issue_id", "uid"), ["issue_id", "uid"], "left_anti"), allowMissingColumns=True)


def clear_reference(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """References to rows that are gone become 0."""
    dead = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone")).distinct()
    return rows.join(dead, column, "left").withColumn(column, F.when(F.col("_gone"), 0).otherwise(F.col(column)).cast("bigint")).select(*rows.columns)


def partial_update(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Rows with the non-null columns of ``changes``."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = table.join(new, key, "left")
    return rows.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*table.columns)


def make_primary(users: DataFrame, addresses: DataFrame, uid: int, email: str) -> tuple[DataFrame, DataFrame]:
    """The user's primary address swapped with an activated one (M14); the old one becomes an ordinary address. Otherwise nothing changes."""
    wanted = addresses.filter((F.col("uid") == uid) & (F.col("email") == email) & F.col("is_activated")).select(F.col("uid").alias("id"), F.lit(email).alias("_new"))
    swapped = users.join(wanted, "id", "left")
    old = swapped.filter("_new is not null").select(F.col("id").alias("uid"), "email", F.col("is_active").alias("is_activated"))
    user = swapped.withColumn("email", F.coalesce("_new", "email")).select(*users.columns)
    return user, add_missing(addresses, old, "uid", "email")


def add_missing(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def change_visibility(tables: dict[str, DataFrame], repo_id: int, private: bool) -> dict[str, DataFrame]:
    """A repository's visibility carried to its feed rows and direct forks."""
    out = dict(tables)
    here = (F.col("id") == repo_id) | (F.col("fork_id") == repo_id)
    out["repository"] = tables["repository"].withColumn("is_private", F.when(here, private).otherwise(F.col("is_private")))
    seen = out["repository"].filter(here).select(F.col("id").alias("repo_id"), (F.col("is_private") | F.col("is_unlisted")).alias("_p"))
    out["action"] = tables["action"].join(seen, "repo_id", "left").withColumn("is_private", F.coalesce("_p", "is_private")).select(*tables["action"].columns)
    return out


def hashed_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens whose SHA-256 is missing get it from their SHA-1."""
    return tokens.withColumn("sha256", F.when(F.col("sha256").isNull(), F.sha2(F.col("sha1").cast("binary"), 256)).otherwise(F.col("sha256")))


def rebuild_whitelist(branches: DataFrame, team_user: DataFrame) -> DataFrame:
    """The whitelist rows of protected branches (M17): (protect_branch_id, repo_id, name, user_id)."""
    from forgeframe.operators.sets import whitelisted

    named = branches.filter("enable_whitelist").select(F.col("id").alias("branch_id"), "repo_id", "name")
    return whitelisted(branches.filter("enable_whitelist"), team_user).join(named, "branch_id").select(F.col("branch_id").alias("protect_branch_id"), "repo_id", "name", "user_id")


def rebuilt_sizes(branches: DataFrame, team_user: DataFrame) -> DataFrame:
    """(protect_branch_id, n): the number of rows that ``rebuild_whitelist`` has for each branch that has any, without making them."""
    from forgeframe.operators.sets import whitelist_sizes

    return whitelist_sizes(branches.filter("enable_whitelist"), team_user).select(F.col("branch_id").alias("protect_branch_id"), "n")


def link_team(tables: dict[str, DataFrame], team_id: int, repo_id: int, remove: bool = False) -> dict[str, DataFrame]:
    """A repository added to (taken from) a team (M18): access recomputed; members watch it, those without access stop."""
    out = dict(tables)
    team = tables["team"].filter(F.col("id") == team_id)
    edge = team.select("org_id", F.col("id").alias("team_id"), F.lit(repo_id).cast("bigint").alias("repo_id"))
    keys = ("org_id", "team_id", "repo_id")
    out["team_repo"] = remove_edges(tables["team_repo"], edge, *keys) if remove else add_edges(tables["team_repo"], edge, *keys)
    here = F.col("repo_id") == repo_id
    modes = access_modes(tables["collaboration"].filter(here), tables["team"], tables["team_user"], out["team_repo"].filter(here), tables["repository"].filter(F.col("id") == repo_id))
    out["access"] = replace_rows(tables["access"], here, modes)
    people = tables["team_user"].filter(F.col("team_id") == team_id).select(F.col("uid").alias("user_id"), F.lit(repo_id).cast("bigint").alias("repo_id"))
    if remove:
        lost = people.join(modes.select("user_id", "repo_id"), ["user_id", "repo_id"], "left_anti")
        out["watch"] = remove_edges(tables["watch"], lost, "user_id", "repo_id")
    else:
        out["watch"] = add_edges(tables["watch"], people, "user_id", "repo_id")
    out["team"] = recounted(tables["team"], "num_repos", out["team_repo"], "team_id")
    return out
