"""Streams in micro-batches, mutations and listings on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from forgeframe.operators import history, issues, joins, mutations, paging
from forgeframe.streaming import flows


def test_push_routing(spark):
    z, a, b = "0" * 40, "1" * 40, "2" * 40
    rows = spark.createDataFrame([(1, "refs/heads/main", a, b), (2, "refs/heads/new", z, b), (3, "refs/heads/old", a, z), (4, "refs/tags/v1", z, b), (5, "refs/tags/v1", a, z)], "id bigint, ref string, old string, new string")
    got = {(r.id, r.place, r.op_type) for r in flows.route_pushes(rows).collect()}
    assert got == {(1, 0, 5), (2, 0, 16), (2, 1, 5), (3, 0, 17), (4, 0, 9), (5, 0, 18)}
    with pytest.raises(Exception, match="both empty"):
        flows.route_pushes(spark.createDataFrame([(6, "refs/heads/x", z, z)], rows.schema)).collect()


def test_feed_stream(spark, tmp_path):
    schema = "id bigint, user_id bigint, act_user_id bigint, repo_id bigint"
    spark.createDataFrame([(1, 0, 7, 1), (2, 0, 8, 2)], schema).write.parquet(str(tmp_path / "in"))
    watch = spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "user_id bigint, repo_id bigint")
    stream = flows.fan_out(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watch)
    q = stream.writeStream.format("memory").queryName("feed_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.user_id) for r in spark.sql("SELECT * FROM feed_out").collect()) == [(1, 7), (1, 8), (1, 9), (2, 8)]


def test_queue_stream(spark, tmp_path):
    schema = "id bigint, kind string, at bigint"
    source = tmp_path / "q"
    spark.createDataFrame([(1, "add", 1), (1, "add", 2), (2, "add", 3)], schema).coalesce(1).write.parquet(str(source))
    q = flows.queue(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("queue_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, "add", 4), (1, "done", 5), (1, "add", 6), (2, "add", 7)], schema).coalesce(1).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.sql("SELECT * FROM queue_out").collect()) == [1, 1, 2]


def test_deliveries(spark):
    tasks = spark.createDataFrame([(1, "http://ok/x", "p", "s"), (2, "http://bad/x", "p", "s"), (3, "http://10.0.0.1/", "p", "s")], "id bigint, url string, payload string, signature string")
    got = flows.deliver(tasks, lambda url, p, s: 500 if "bad" in url else 204, lambda host: host.startswith("10."))
    assert {(r.id, r.is_delivered, r.is_succeed) for r in got.collect()} == {(1, True, True), (2, True, False), (3, False, False)}


@pytest.mark.parametrize(
    "after, limit, tags, latest, previous, following",
    [
        ("", 3, ["v9", "v8", "v7"], True, "", True),
        ("v8", 3, ["v7", "v6", "v5"], False, "", True),
        ("v6", 3, ["v5", "v4", "v3"], False, "v9", True),
        ("v4", 3, ["v3", "v2", "v1"], False, "v7", False),
        ("v1", 3, [], False, "v4", False),
        ("nope", 3, ["v9", "v8", "v7"], True, "", True),
        ("v8", 0, ["v7", "v6", "v5", "v4", "v3", "v2", "v1"], False, "", False),
    ],
)
def test_tag_pages(spark, after, limit, tags, latest, previous, following):
    rows = spark.createDataFrame([(i, f"v{9 - i}") for i in range(9)], "at bigint, name string")
    assert tuple(issues.tags_after(rows, "at", "name", after, limit).first()) == (tags, latest, previous, following)


def test_pages():
    assert (paging.page_size(0), paging.page_size(7), paging.page_size(99)) == (10, 7, 50)
    assert paging.page_links(45, 10, 2) == {"next": 3, "last": 5, "first": 1, "prev": 1} and paging.page_links(5, 10, 1) == {}


def test_access(spark):
    access = spark.createDataFrame([(2, 1, 2), (3, 1, 3), (1, 2, 1)], "user_id bigint, repo_id bigint, mode bigint")
    repos = spark.createDataFrame([(1, 98, False), (2, 99, True)], "id bigint, owner_id bigint, is_private boolean")
    from forgeframe.operators.aggregates import effective_access

    asked = spark.createDataFrame([(0, 1), (0, 2), (98, 1), (99, 2), (1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (5, 77)], "user_id bigint, repo_id bigint")
    got = {(r.user_id, r.repo_id): r["mode"] for r in effective_access(asked, repos, access).collect()}
    assert got == {(0, 1): 1, (0, 2): 0, (98, 1): 4, (99, 2): 4, (1, 1): 1, (2, 1): 2, (3, 1): 3, (1, 2): 1, (2, 2): 0, (5, 77): 0}


def test_email_owner(spark):
    users = spark.createDataFrame([(1, "a@x", True, 0), (2, "b@x", False, 0), (3, "c@x", True, 1)], "id bigint, email string, is_active boolean, type bigint")
    other = spark.createDataFrame([(1, "a2@x", True), (1, "a3@x", False)], "uid bigint, email string, is_activated boolean")
    found = lambda m: [r.id for r in joins.by_email(users, other, m).collect()]
    assert [found(m) for m in ("A@x", "a2@x", "a3@x", "b@x", "c@x", "z")] == [[1], [1], [], [], [], []]


def test_edges_are_added_once(spark):
    edges = spark.createDataFrame([(4, 1, 2)], "id bigint, user_id bigint, follow_id bigint")
    new = spark.createDataFrame([(1, 2), (2, 1), (2, 1)], "user_id bigint, follow_id bigint")
    once = mutations.add_edges(edges, new, "user_id", "follow_id")
    assert sorted(map(tuple, once.collect())) == [(4, 1, 2), (5, 2, 1)]
    assert sorted(map(tuple, mutations.add_edges(once, new, "user_id", "follow_id").collect())) == [(4, 1, 2), (5, 2, 1)]
    many = mutations.add_edges(edges, spark.range(10_000).selectExpr("id AS user_id", "7L AS follow_id"), "user_id", "follow_id")
    assert sorted(r.id for r in many.collect()) == list(range(4, 10_005))


def test_history(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    commits = spark.createDataFrame(pd.DataFrame({"sha": list("abcdef"), "parents": [[], ["a"], ["b"], ["b"], ["c", "d"], ["d"]], "topo": range(6), "message": ["m"] * 6}))
    assert [r.sha for r in history.merge_base(commits, "c", "f").collect()] == ["b"]
    assert {r.sha for r in history.between(commits, "c", "f").collect()} == {"d", "f"}
    assert {r.sha for r in history.between(commits, "c", "f", True).collect()} == {"c", "d", "f"}
    changes = spark.createDataFrame([("a", "x/1", "A"), ("b", "x/2", "A"), ("c", "x/1", "M"), ("c", "y", "D")], "sha string, path string, status string")
    assert [r.sha for r in history.page(commits, 1, 10, changes, "x").collect()] == ["c", "b", "a"]
    got = {r.sha: (r.added, r.removed, r.modified) for r in history.name_status(changes).collect()}
    assert got["c"] == ([], ["y"], ["x/1"])
    entries = spark.createDataFrame([("x",), ("y",), ("z",)], "entry string")
    assert {(r.entry, r.sha) for r in history.tree_listing(entries, changes, commits).collect()} == {("x", "c"), ("y", "c"), ("z", None)}
    plan = history.tree_listing(entries, changes, commits)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert history.commit_count(commits, "e").first().n == 5 and history.commit_count(commits, "zz").first().n == 0
    assert {r.path for r in history.changed_names(commits, changes, "d", "c").collect()} == {"x/1", "y"}
    chain = spark.range(60).selectExpr("CAST(id AS STRING) AS sha", "IF(id > 0, array(CAST(id - 1 AS STRING)), array()) AS parents", "id AS topo")
    assert history.commit_count(chain, "49").first().n == 50


def test_mail_order(spark):
    from forgeframe.operators.aggregates import recipients

    users = spark.createDataFrame([(1, "Ann", "a", 0, True), (2, "bob", "b", 0, False), (3, "ANN", "c", 0, True), (4, "eve", "e", 1, True)], "id bigint, name string, email string, type bigint, is_active boolean")
    e = lambda *ids: spark.createDataFrame([(9, i) for i in ids], "issue_id bigint, user_id bigint")
    got = recipients(e(1, 4, 2), e(3, 2), e(4), users, 99)
    assert {(r.name, r.email) for r in got.collect()} == {("Ann", "a"), ("bob", "b"), ("eve", "e")}
    assert got.filter(F.col("issue_id") == 9).count() == 3


def test_recipients_by_repository(spark):
    """The form that fans out last gives what the plain one gives."""
    import random

    from forgeframe.operators.aggregates import issue_recipients, recipients

    draw = random.Random(4)
    names = ["Ann", "ANN", "bob", "Bob", "eve", "Zoe", "zoe"]
    users = spark.createDataFrame([(i, draw.choice(names) + str(i % 5), f"e{i}", i % 4 // 3, i % 5 > 0) for i in range(60)], "id bigint, name string, email string, type bigint, is_active boolean")
    pairs = lambda n, m: spark.createDataFrame([(draw.randrange(m), draw.randrange(60)) for _ in range(n)], "a bigint, user_id bigint")
    issues = spark.createDataFrame([(i, i % 4) for i in range(12)], "issue_id bigint, repo_id bigint")
    watch = pairs(70, 4).withColumnRenamed("a", "repo_id")
    people, assigned = (pairs(n, 12).withColumnRenamed("a", "issue_id") for n in (40, 10))
    want = recipients(issues.join(watch, "repo_id").select("issue_id", "user_id").distinct(), people, assigned, users, 7)
    got = issue_recipients(issues, watch, people, assigned, users, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_salted_fan_out(spark):
    actions = spark.createDataFrame([(i, i % 7, i % 3, i % 5) for i in range(50)], "id bigint, user_id bigint, repo_id bigint, act_user_id bigint")
    watch = spark.createDataFrame([(i % 3, i % 11) for i in range(40)], "repo_id bigint, user_id bigint")
    plain = sorted(map(tuple, flows.fan_out(actions, watch).collect()))
    assert sorted(map(tuple, flows.fan_out(actions, watch, 5).collect())) == plain and len(plain) > 100
