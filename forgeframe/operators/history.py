"""Version history as tables: commits (sha, parents array, topo, message), file changes, tree entries (§ git views).

Ancestors are found by growing sets of (start, sha) along parent edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(commits: DataFrame, number: int, size: int = 30, changes: DataFrame | None = None, path: str = "") -> DataFrame:
    """A page of history in topological order, optionally of commits that touch a path."""
    rows = commits
    if path and changes is not None:
        rows = rows.join(changes.filter((F.col("path") == path) | F.col("path").startswith(path + "/")).select("sha").distinct(), "sha", "left_semi")
    return rows.orderBy(F.desc("topo"), "sha").offset((max(1, number) - 1) * size).limit(size)


def search(commits: DataFrame, keyword: str) -> DataFrame:
    return commits.filter(F.lower("message").contains(keyword.lower()))


def ancestors(commits: DataFrame, starts: DataFrame, merge_every: int = 16) -> DataFrame:
    """(start, sha): every commit that each start reaches, itself included.

    A round joins only what the round before has newly found with the parent edges, and writes
    only that; every ``merge_every`` rounds the rounds' tables are put together. A history takes
    as many rounds as its longest way from a start to a root.
    """
    edge = commits.select(F.col("sha").alias("a"), F.explode("parents").alias("b")).distinct().checkpoint()
    new = starts.select(F.col("sha").alias("start"), "sha").distinct().checkpoint()
    rounds = [new]
    while True:
        found = reduce(DataFrame.unionByName, rounds)
        more = new.join(edge, F.col("sha") == F.col("a")).select("start", F.col("b").alias("sha")).distinct()
        new = more.join(found, ["start", "sha"], "left_anti").checkpoint()
        if new.isEmpty():
            return found
        rounds.append(new)
        if len(rounds) > merge_every:
            rounds = [reduce(DataFrame.unionByName, rounds).checkpoint()]


def between(commits: DataFrame, base: str, head: str, symmetric: bool = False) -> DataFrame:
    """Commits of head that base lacks (``..``), or that only one has (``...``)."""
    spark = commits.sparkSession
    reach = ancestors(commits, spark.createDataFrame([(base,), (head,)], "sha string"))
    has = reach.groupBy("sha").agg(F.max(F.col("start") == base).alias("in_base"), F.max(F.col("start") == head).alias("in_head"))
    keep = F.col("in_base") != F.col("in_head") if symmetric else F.col("in_head") & ~F.col("in_base")
    return commits.join(has.filter(keep).select("sha"), "sha", "left_semi")


def merge_base(commits: DataFrame, a: str, b: str) -> DataFrame:
    """The newest common ancestor."""
    reach = ancestors(commits, commits.sparkSession.createDataFrame([(a,), (b,)], "sha string"))
    common = reach.groupBy("sha").agg(F.count_distinct("start").alias("n")).filter(F.col("n") == (1 if a == b else 2))
    return commits.join(common.select("sha"), "sha", "left_semi").orderBy(F.desc("topo"), "sha").limit(1)


def name_status(changes: DataFrame) -> DataFrame:
    """(sha, added, removed, modified): sorted file names by what happened to them."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("status") == kind, F.col("path"))))
    return changes.groupBy("sha").agg(of("A").alias("added"), of("D").alias("removed"), of("M").alias("modified"))


def commit_count(commits: DataFrame, head: str) -> DataFrame:
    """One row n: how many commits a head reaches, itself included."""
    reach = ancestors(commits, commits.sparkSession.createDataFrame([(head,)], "sha string"))
    return reach.join(commits.select("sha"), "sha", "left_semi").agg(F.count("*").alias("n"))


def changed_names(commits: DataFrame, changes: DataFrame, base: str, head: str) -> DataFrame:
    """(path): names that head changes against base, from the commits that only head has."""
    return changes.join(between(commits, base, head).select("sha"), "sha", "left_semi").select("path").distinct()


def folders(path):
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def tree_listing(entries: DataFrame, changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(entry, sha): each tree entry with the newest commit that changed it or something below it."""
    touched = changes.join(commits.select("sha", "topo"), "sha").select("sha", "topo", F.explode(folders(F.col("path"))).alias("entry"))
    newest = touched.groupBy("entry").agg(F.max_by("sha", F.struct("topo", "sha")).alias("sha"))
    return entries.select("entry").distinct().join(newest, "entry", "left")
