"""Queries on tables in which few keys have very many rows, and on more keys than the smallest tables have."""

import random

import duckdb
from pyspark.sql import functions as F

from forgeframe.operators import aggregates as A
from forgeframe.operators import mutations as M
from forgeframe.operators import sets
from forgeframe.plans import registry
from forgeframe.streaming import flows


def against_sql(spark, name: str, sf: str, tables: str) -> None:
    con = duckdb.connect()
    for t in tables.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.queries()[name](spark, sf)
    cur = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def test_blocked_hosts_of_all_digits(spark):
    against_sql(spark, "blocked_hosts", "/root/testdata/sf0.1", "customer")


def rows_made(df) -> int:
    """The most rows that an operator of an executed plan put out, however it was re-planned."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def teams_of(spark, seed: int):
    """collaboration, team, team_user, team_repo, repository with repeats, nulls and users of several teams."""
    rng = random.Random(seed)
    some = lambda n, *tops: [tuple(rng.choice([None, *range(1, top + 1)]) for top in tops) for _ in range(n)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names.split()))
    team = [(i, rng.randint(1, 3), rng.choice(["owners", "a", "b", None]), rng.choice([1, 2, 3, None])) for i in range(1, 8)]
    return (
        frame(some(60, 20, 25, 4), "user_id repo_id mode"),
        spark.createDataFrame(team, "id bigint, org_id bigint, lower_name string, authorize bigint"),
        frame(some(40, 20, 8), "uid team_id"),
        frame(some(40, 25, 8), "repo_id team_id"),
        frame([(i, rng.choice([None, 1, 2, 3])) for i in range(1, 26)], "id owner_id"),
    )


def test_access_totals_equal_the_rows(spark):
    for seed in range(6):
        tables = teams_of(spark, seed)
        want = A.access_modes(*tables).groupBy("mode").agg(F.count("*").alias("n"), F.sum("user_id").alias("u"), F.sum("repo_id").alias("r"))
        assert sorted(map(tuple, A.access_totals(*tables).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_access_is_not_counted_by_pairs(spark):
    """A team of 1500 members with 1500 repositories: 2,250,000 grants, of which no row is made."""
    team = spark.createDataFrame([(1, 1, "a", 2)], "id bigint, org_id bigint, lower_name string, authorize bigint")
    many = spark.range(1, 1501)
    totals = A.access_totals(
        spark.createDataFrame([(1, 1, 3), (2000, 1, 4)], "user_id bigint, repo_id bigint, mode bigint"), team,
        many.select(F.col("id").alias("uid"), F.lit(1).alias("team_id")), many.select(F.col("id").alias("repo_id"), F.lit(1).alias("team_id")),
        many.select("id", F.lit(9).alias("owner_id")),
    )
    assert sorted(map(tuple, totals.collect())) == [(2, 2249999, 1688625000 - 1, 1688625000 - 1), (3, 1, 1, 1), (4, 1, 2000, 1)]
    assert rows_made(totals) < 10_000
    assert rows_made(registry.queries()["access_max_merge"](spark, "/root/testdata/sf0.01")) < 100_000


def test_access_after_a_team_is_not_counted_by_pairs(spark):
    assert rows_made(registry.queries()["team_delete"](spark, "/root/testdata/sf0.01")) < 100_000
    teams, people, grants = (spark.createDataFrame(*x) for x in (([(1, 1, "a", 2), (3, 1, "a", 3)], "id bigint, org_id bigint, lower_name string, authorize bigint"), ([(1, 5), (3, 5), (3, 6)], "team_id bigint, uid bigint"), ([(1, 7), (3, 7), (3, 8)], "team_id bigint, repo_id bigint")))
    tables = {"team": teams, "team_user": people, "team_repo": grants, "collaboration": spark.createDataFrame([], "user_id bigint, repo_id bigint, mode bigint"), "repository": spark.createDataFrame([], "id bigint, owner_id bigint")}
    out = M.delete_team(tables, 3)
    assert [tuple(r) for r in out["access"].collect()] == [(5, 7, 2)]
    assert [tuple(r) for r in A.access_totals(*(out[n] for n in ("collaboration", "team", "team_user", "team_repo", "repository"))).collect()] == [(2, 1, 5, 7)]


def test_recipients_are_not_counted_by_issue_and_watcher(spark):
    """300 issues of a repository with 300 watchers; totals equal the rows."""
    many = spark.range(1, 301)
    issues = many.select(F.col("id").alias("issue_id"), F.lit(1).alias("repo_id")).unionByName(spark.createDataFrame([(901, 2), (902, 2), (903, 3)], "issue_id bigint, repo_id int"))
    users = spark.range(1, 400).select("id", F.concat(F.lit("N"), F.col("id") % 350).alias("name"), F.concat(F.lit("m"), F.col("id")).alias("email"), (F.col("id") % 7 == 0).cast("int").alias("type"), (F.col("id") % 5 > 0).alias("is_active"))
    people = spark.createDataFrame([(1, 390), (1, 391), (2, 3), (2, 5), (901, 5), (901, 9), (902, 6)], "issue_id bigint, user_id bigint")
    inputs = issues, many.select(F.lit(1).alias("repo_id"), F.col("id").alias("user_id")), people, spark.createDataFrame([(1, 392), (901, 359), (902, 6)], "issue_id bigint, user_id bigint"), users, 6
    totals = A.recipient_totals(*inputs)
    want = A.issue_recipients(*inputs).groupBy("issue_id").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("email").alias("last"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, want.collect()))
    assert rows_made(totals) < 10_000 < rows_made(want)
    assert rows_made(registry.queries()["mail_recipients"](spark, "/root/testdata/sf0.01")) < 100_000


def whitelists(spark):
    """Protected branches with repeats, blanks, no list, and users who are in several of a branch's teams."""
    rows = [(1, "0,5,5, 7,x", "1,2"), (2, "", "3"), (3, "8", "9,z"), (4, None, "1,3,3"), (5, "40", None), (6, "0", "")]
    rows += [(i, "41", "1" if i % 2 else "1,2") for i in range(100, 400)]
    branches = spark.createDataFrame([(i, i % 4, f"b{i}", i != 5, u, t) for i, u, t in rows], "id bigint, repo_id bigint, name string, enable_whitelist boolean, whitelist_user_ids string, whitelist_team_ids string")
    links = [(t, u) for u in range(300) for t in (1, 2, 3) if u % (t + 1) < 2] + [(None, 3), (1, None), (2, 7), (2, 7)]
    members = lambda text: {u for x in (text or "").split(",") for t, u in links if x.strip().isdigit() and t == int(x) and u}
    want = {(i, u) for i, us, ts in rows for u in members(ts) | {int(x) for x in (us or "").split(",") if x.strip().isdigit()} if u}
    return branches, spark.createDataFrame(links, "team_id bigint, uid bigint"), want


def test_whitelist_sizes(spark):
    branches, links, want = whitelists(spark)
    on = sorted((i, sum(b == i for b, _ in want)) for i in {b for b, _ in want} - {5})
    sizes = M.rebuilt_sizes(branches, links)
    assert sorted(map(tuple, sizes.collect())) == on and sum(n for _, n in on) > 20_000
    assert rows_made(sizes) < 10_000
    rows = M.rebuild_whitelist(branches, links)
    assert sorted(map(tuple, rows.groupBy("protect_branch_id").count().collect())) == on
    assert rows_made(registry.queries()["whitelist_rebuild"](spark, "/root/testdata/sf0.01")) < 5_000


def test_whitelisted_pairs_are_not_shuffled(spark):
    branches, links, want = whitelists(spark)
    rows = sets.whitelisted(branches, links)
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    top = rows._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    # above the join that makes the pairs stand no aggregate and no exchange
    assert "Aggregate" not in top.split("Join")[0] and "Exchange" not in top.split("Join")[0]


def test_feed_fanout_rows_pack(spark, tmp_path):
    """A repository with more watchers than a page of a column file has rows: its output stays small, whole and in many tasks."""
    many, acts = 24_000, 200
    spark.range(acts).selectExpr("id * 100 + 7 as event_id", "id as user_id", "'click' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(2 * many).selectExpr(f"id % {many} as l_suppkey", "7L as l_partkey", "'A' as l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of full size
    try:
        registry.queries()["feed_fanout"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    out = spark.read.parquet(str(tmp_path / "out"))
    by_id = out.groupBy("id").agg(F.count("*").alias("n"), F.sum("user_id").alias("to"), F.countDistinct("user_id").alias("kinds"))
    assert by_id.count() == acts and by_id.filter(f"n <> {many} or kinds <> {many} or to <> {many * (many - 1) // 2}").count() == 0
    files = list((tmp_path / "out").glob("*.parquet"))
    # 4 bytes a row if each action comes with all watchers at once
    assert sum(f.stat().st_size for f in files) < many * acts
    assert max(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()) < 0.3 * many * acts


def test_fan_out_in_blocks(spark):
    """Rows as by plain loops, with sparse and negative ids, blocks of every size, repeats and nulls."""
    rng = random.Random(8)
    watchers = {1: range(-600, 905), 2: [rng.randrange(-(2**62), 2**62) for _ in range(50)], 3: range(16_383 - 504, 16_384 + 504), 4: [7], 5: [None]}
    watch = spark.createDataFrame([(r, u) for r, us in watchers.items() for u in us for _ in range(1 + (r == 4))] + [(None, 3)], "repo_id bigint, user_id bigint")
    acts = [(i, None, r, u) for i, (r, u) in enumerate((r, u) for r in (1, 2, 3, 4, 5, 6, None) for u in (7, 7, 16_384, None))]
    actions = spark.createDataFrame(acts, "id bigint, user_id bigint, repo_id bigint, act_user_id bigint")
    want = [(i, a, r, a) for i, _, r, a in acts] + [(i, u, r, a) for i, _, r, a in acts for u in watchers.get(r, ()) if None not in (u, a) and u != a]
    for salts in (1, 5, flows.DEALT):
        assert sorted(map(tuple, flows.fan_out(actions, watch, salts).collect()), key=str) == sorted(want, key=str)


def test_fan_out_hands_rows_on(spark):
    """The first row of a block of watchers goes on before its others, 1.5 million with 3,000 actions, are made."""
    watch = spark.range(1, 505).selectExpr("id % 1 + 1 as repo_id", "id as user_id")
    actions = spark.range(3_000).selectExpr("id", "0L as user_id", "id % 1 + 1 as repo_id", "id % 40 + 1 as act_user_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in ("-1", old):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            for salts in (1, flows.DEALT):
                first = flows.fan_out(actions, watch, salts).filter("user_id <> act_user_id").limit(1)
                assert rows_made(first) < 10_000 and first.count() == 1
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fan_out_totals(spark):
    """Totals equal those of the rows, with actors who watch, repeats and nulls; none is made for an action and watcher."""
    rng = random.Random(5)
    pick = lambda top: rng.choice([None, *range(1, top + 1)])
    actions = spark.createDataFrame([(i, 9, pick(4), pick(30)) for i in range(600)], "id bigint, user_id bigint, repo_id bigint, act_user_id bigint")
    watch = spark.createDataFrame([(pick(4), pick(200)) for _ in range(900)], "repo_id bigint, user_id bigint")
    want = flows.fan_out(actions, watch).groupBy("user_id", "repo_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("act_user_id").alias("actors"))
    totals = flows.fan_out_totals(actions, watch)
    assert sorted(map(tuple, totals.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert rows_made(totals) < 2_000 < 20_000 < rows_made(want)
    # 867,850 rows go out to receivers; the sink holds at most one for each of them and a repository
    assert rows_made(registry.queries()["stream_fanout"](spark, "/root/testdata/sf0.01")) < 50_000


def test_url_models_and_threshold_come_from_all_labelled_urls(spark, monkeypatch):
    from forgeframe.llm import url_filter
    from forgeframe.llm.queries import RULES

    seen = {"train": [], "threshold": []}
    for name in seen:
        plain = getattr(url_filter, name)
        monkeypatch.setattr(url_filter, name, lambda rows, *more, name=name, plain=plain: (seen[name].append(rows.count()), plain(rows, *more))[1])
    urls = [f"http://s{i}.example.net/en/{i}" for i in range(70)] + [f"http://casino{i}.net/win/{i}" for i in range(50)] + [f"http://casino{i}.com/win/{i}" for i in range(30)]
    rows = url_filter.judge(spark.createDataFrame([(u,) for u in urls + urls], "url string"), RULES).collect()
    assert max(seen["train"]) == 120 and sum(sorted(seen["train"])[:-1]) == 120 and seen["threshold"] == [120]
    assert sum(r.verdict == "block" for r in rows if r.rule is None) >= 54


def test_hooks_meet_only_events_that_they_want(spark):
    """400 events and 300 hooks of one repository, of which 20 want some: no more rows on the way than tasks or inputs."""
    import hashlib
    import hmac

    settings = lambda i: '{"push_only":%s,"send_everything":%s}' % ("true" if 10 <= i < 20 else "false", "true" if i < 10 else "false")
    hooks = [(i, 1 if i < 300 else 2, 10 if i == 3 else 90, i % 9 > 0, f"u{i}", ["", "k", "q"][i % 3], settings(i)) for i in range(310)]
    events = [(i, 1, 10 if i % 2 else 0, "push" if i % 4 == 0 else "fork", f"p{i}") for i in range(400)]
    tasks = flows.route_hooks(
        spark.createDataFrame(events, "event_id bigint, repo_id bigint, org_id bigint, event string, payload string"),
        spark.createDataFrame(hooks, "id bigint, repo_id bigint, org_id bigint, is_active boolean, url string, secret string, events string"),
    )
    sign = lambda secret, p: "" if secret == "" else hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest()
    want = [(*e, h[0], h[4], sign(h[5], e[4]), False) for e in events for h in hooks for hit in (e[1] == h[1], e[2] > 0 and e[2] == h[2]) if hit and h[3] and (h[0] < 10 or (10 <= h[0] < 20 and e[3] == "push"))]
    assert sorted(map(tuple, tasks.collect()), key=str) == sorted(want, key=str) and 4_000 < len(want) < 6_000
    assert rows_made(tasks) < 10_000
    # signed below the join that makes the tasks: once for each secret, not once for each hook
    assert "sha2" not in tasks._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
