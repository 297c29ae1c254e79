"""Set operations (U1-U10) and listing pages built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_file_sources(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Login sources of the database and of files, all kept."""
    return stored.unionByName(files, allowMissingColumns=True)


def hooks_of(webhook: DataFrame, repo_id: int, org_id: int) -> DataFrame:
    """Active hooks of a repository and then of its organisation."""
    active = webhook.filter("is_active")
    own = active.filter(F.col("repo_id") == repo_id)
    return own.unionByName(active.filter(F.col("org_id") == org_id)) if org_id > 0 else own


def emails_of(users: DataFrame, addresses: DataFrame, uid: int) -> DataFrame:
    """(email, is_activated, is_primary): a user's addresses, the primary one added if it isn't among them (U4)."""
    user = users.filter(F.col("id") == uid).select(F.col("email").alias("_primary"), "is_active")
    mine = addresses.filter(F.col("uid") == uid)
    primary = user.select(F.col("_primary").alias("email"), F.col("is_active").alias("is_activated"), F.lit(True).alias("is_primary"))
    marked = mine.join(user.select(F.col("_primary").alias("email"), F.lit(True).alias("_p")), "email", "left")
    rows = marked.select("email", "is_activated", F.coalesce("_p", F.lit(False)).alias("is_primary"))
    return rows.unionByName(primary.join(mine.select("email"), "email", "left_anti"))


def users_with_access(users: DataFrame, access: DataFrame, repos: DataFrame, repo_id: int, mode: int) -> DataFrame:
    """Holders of at least a mode on a repository and its owner, unless that is an organisation (U5); the owner may repeat."""
    holders = users.join(access.filter((F.col("repo_id") == repo_id) & (F.col("mode") >= mode)).select(F.col("user_id").alias("id")), "id")
    owner = users.filter(F.col("type") == 0).join(repos.filter(F.col("id") == repo_id).select(F.col("owner_id").alias("id")), "id")
    return holders.unionByName(owner)


def releases_page(releases: DataFrame, latest: bool, size: int) -> DataFrame:
    """Published releases by commits and time, newest first; on the latest page drafts come before them."""
    order = [F.desc("num_commits"), F.desc("created_unix"), F.desc("id")]
    published = releases.filter("not is_draft").orderBy(*order).limit(size).withColumn("_part", F.lit(1))
    if not latest:
        return published.drop("_part").orderBy(*order)
    drafts = releases.filter("is_draft").withColumn("_part", F.lit(0))
    return drafts.unionByName(published).orderBy("_part", *order).drop("_part")


#: Parts over which the members of a team are dealt.
PARTS = 64


def whitelist_parts(branches: DataFrame, team_user: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A branch's users in classes, each user once: (branch_id, class), (class, user_id) and the rest (branch_id, user_id).

    Users of the same teams are one class (an array of their teams), which a branch has if it names any of these;
    the rest are users named on the branch's list who are in none of its classes. 0 is dropped.
    """
    ids = lambda column, name: branches.select(F.col("id").alias("branch_id"), F.explode(F.split(column, ",")).alias("t")).select("branch_id", F.expr("try_cast(trim(t) as bigint)").alias(name)).filter(F.col(name).isNotNull()).distinct()
    named, teams = ids("whitelist_user_ids", "user_id").filter("user_id <> 0"), ids("whitelist_team_ids", "team_id")
    members = team_user.select("team_id", F.col("uid").alias("user_id")).filter("user_id <> 0").join(teams.select("team_id"), "team_id", "left_semi")
    members = members.groupBy("user_id").agg(F.array_sort(F.collect_set("team_id")).alias("class"))
    classes = members.select("class").distinct().withColumn("team_id", F.explode("class"))
    held = teams.join(classes, "team_id").select("branch_id", "class").distinct()
    rest = named.join(members, "user_id", "left").join(held.withColumn("_has", F.lit(True)), ["branch_id", "class"], "left").filter("_has is null").select("branch_id", "user_id")
    return held, members, rest


def whitelisted(branches: DataFrame, team_user: DataFrame) -> DataFrame:
    """(branch_id, user_id): users named on a branch's list and members of the named teams, each once, 0 dropped (U8).

    No pair is made twice, so none is shuffled. Members are dealt over parts, to each of which the branches go: a team
    that very many branches name is not one task.
    """
    held, members, rest = whitelist_parts(branches, team_user)
    members = members.withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int")).repartition(PARTS, "class", "_part")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(PARTS, "class", "_part")
    return held.join(members, ["class", "_part"]).select("branch_id", "user_id").unionByName(rest)


def whitelist_sizes(branches: DataFrame, team_user: DataFrame) -> DataFrame:
    """(branch_id, n): the number of users in ``whitelisted`` of each branch that has any, without a row for each."""
    held, members, rest = whitelist_parts(branches, team_user)
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    both = held.join(sizes, "class").select("branch_id", "n").unionByName(rest.groupBy("branch_id").agg(F.count("*").alias("n")))
    return both.groupBy("branch_id").agg(F.sum("n").alias("n"))


def template_names(built_in: DataFrame, custom: DataFrame, preferred: list[str]) -> DataFrame:
    """(name): both lists, one of each name without regard to case (custom ones win), preferred ones first, then by name."""
    rows = built_in.select("name", F.lit(1).alias("_p")).unionByName(custom.select("name", F.lit(0).alias("_p")))
    one = rows.groupBy(F.lower("name").alias("_low")).agg(F.min_by("name", F.struct("_p", "name")).alias("name"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col("name")), F.lit(0)) if preferred else F.lit(0)
    return one.withColumn("_r", F.when(rank > 0, rank).otherwise(len(preferred) + 1)).orderBy("_r", "name").select("name")


def repos_with_permissions(repos: DataFrame, access: DataFrame, uid: int) -> DataFrame:
    """(id, admin, push, pull): own repositories with all permissions, accessible ones by mode."""
    own = repos.filter(F.col("owner_id") == uid).select("id", F.lit(True).alias("admin"), F.lit(True).alias("push"), F.lit(True).alias("pull"))
    mine = access.filter((F.col("user_id") == uid) & (F.col("mode") >= 1)).select(F.col("repo_id").alias("id"), "mode")
    shared = repos.join(mine, "id").filter(F.col("owner_id") != uid).select("id", (F.col("mode") >= 3).alias("admin"), (F.col("mode") >= 2).alias("push"), F.lit(True).alias("pull"))
    return own.unionByName(shared)
