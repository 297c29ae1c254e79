"""Chat messages, charsets, registered SQL functions, exclusion and the archive wrapper."""

import random

import pytest
from pyspark.sql import functions as F

from forgeframe.functions import charset, chat, register
from forgeframe.functions import text as T
from forgeframe.sources import archive
from forgeframe.streaming import flows

BASE = {"repo": "site", "full_name": "u/site", "url": "https://g/u/site", "site": "https://g/", "sender": "ann", "pusher": "ann"}
ISSUE = BASE | {"event": "issues", "index": 7, "title": "a < b", "body": "x & y", "assignee": "bob", "milestone": "m1", "labels": ["l1", "l2"]}
PULL = ISSUE | {"event": "pull_request"}
LINK, BY = "<https://g/u/site/issues/7|#7 a &lt; b>", "by <https://g/ann|ann>"
COMMITS = [{"id": "0123456789", "url": "https://c/1", "message": "one\nmore", "author": "Ann"}, {"id": "abcdef0123", "url": "https://c/2", "message": "two & <b>", "author": "Bob"}]
CASES = [
    (BASE | {"event": "create", "ref": "refs/heads/dev", "ref_type": "branch"}, "[<https://g/u/site|site>:<https://g/u/site/src/dev|dev>] branch created by ann", "Created new branch: [site](https://g/u/site)/[dev](https://g/u/site/src/dev)", "# New Branch Create Event\n- Repo: **[site](https://g/u/site)**\n- New Branch: **[dev](https://g/u/site/src/dev)**"),
    (BASE | {"event": "delete", "ref": "refs/tags/v1", "ref_type": "tag"}, "[<https://g/u/site|site>:v1] tag deleted by ann", "Deleted tag: [site](https://g/u/site)/v1", "# Tag Delete Event\n- Repo: **[site](https://g/u/site)**\n- Tag: **v1**"),
    (BASE | {"event": "fork", "fork": "b/site", "fork_url": "https://g/b/site"}, "<https://g/u/site|site> is forked to <https://g/b/site|b/site>", "[site](https://g/u/site) is forked to [b/site](https://g/b/site)", "# Repo Fork Event\n- From Repo: **[site](https://g/u/site)**\n- To Repo: **[b/site](https://g/b/site)**"),
    (BASE | {"event": "push", "ref": "refs/heads/dev", "compare_url": "https://g/c", "commits": COMMITS}, "[<https://g/u/site|site>:<https://g/u/site/src/dev|dev>] <https://g/c|2 new commits> pushed by ann", "Pushed [2 new commits](https://g/c) to [site](https://g/u/site)/[dev](https://g/u/site/src/dev)\n[`0123456`](https://c/1) one - Ann\n[`abcdef0`](https://c/2) two & <b> - Bob", "# Repo Push Event\n- Repo: **[site](https://g/u/site)**\n- Ref: **[dev](https://g/u/site/src/dev)**\n- Pusher: **ann**\n## Total 2 commits(s)\n> 0. [0123456](https://c/1) Ann - one\n> 1. [abcdef0](https://c/2) Bob - two & <b>\n"),
    (BASE | {"event": "push", "ref": "dev", "compare_url": "", "commits": COMMITS[:1]}, "[<https://g/u/site|site>:<https://g/u/site/src/dev|dev>] 1 new commit pushed by ann", "Pushed 1 new commit to [site](https://g/u/site)/[dev](https://g/u/site/src/dev)\n[`0123456`](https://c/1) one - Ann", None),
    (ISSUE | {"action": "opened"}, f"[u/site] New issue created {BY}", "x & y", "# Issue Event Opened\n- Issue: **[#7 a < b](https://g/u/site/issues/7)**\n> x & y"),
    (ISSUE | {"action": "closed"}, f"[u/site] Issue closed: {LINK} {BY}", "", None),
    (ISSUE | {"action": "reopened"}, f"[u/site] Issue re-opened: {LINK} {BY}", "", None),
    (ISSUE | {"action": "assigned"}, f"[u/site] Issue assigned to <https://g/bob|bob>: {LINK} {BY}", "", "# Issue Event Assigned\n- Issue: **[#7 a < b](https://g/u/site/issues/7)**\n- New Assignee: **bob**\n> x & y"),
    (ISSUE | {"action": "label_updated", "labels": []}, f"[u/site] Issue labels updated: {LINK} {BY}", "", "# Issue Event Label_updated\n- Issue: **[#7 a < b](https://g/u/site/issues/7)**\n- Labels: **empty**\n> x & y"),
    (ISSUE | {"action": "synchronized"}, None, "", None),
    (PULL | {"action": "closed", "merged": True}, f"[u/site] Pull request merged: {LINK.replace('issues', 'pulls')} {BY}", "", "# Pull Request Merged\n- PR: [#7 a < b](https://g/u/site/pulls/7)"),
    (PULL | {"action": "closed", "merged": False}, f"[u/site] Pull request closed: {LINK.replace('issues', 'pulls')} {BY}", "", "# Pull Request Closed\n- PR: [#7 a < b](https://g/u/site/pulls/7)"),
    (PULL | {"action": "synchronized"}, f"[u/site] Pull request synchronized: {LINK.replace('issues', 'pulls')} {BY}", "", None),
    (PULL | {"action": "milestoned"}, f"[u/site] Pull request milestoned: {LINK.replace('issues', 'pulls')} {BY}", "", "# Pull Request Milestoned\n- PR: [#7 a < b](https://g/u/site/pulls/7)\n- New Milestone: *m1*"),
    (ISSUE | {"event": "issue_comment", "action": "created", "comment_id": 3, "comment": "hi <b>"}, f"[u/site] New comment created {BY}", "hi <b>", "# Issue Comment Created\n- Issue: [#7 a < b](https://g/u/site/issues/7)\n- Comment content: \n> hi <b>"),
    (BASE | {"event": "release", "tag": "v1", "release_name": "One", "draft": False, "prerelease": True, "body": "b"}, "[<https://g/u/site|site>] new release <https://g/u/site/src/v1|v1> published by ann", "Published new release [v1](https://g/u/site/src/v1) of [site](https://g/u/site)", "# New Release Published\n- Repo: [site](https://g/u/site)\n- Tag: [v1](https://g/u/site/src/v1)\n- Author: ann\n- Draft?: false\n- Pre Release?: true\n- Title: One\n- Note: b"),
    (BASE | {"event": "other"}, None, None, None),
]


def test_chat_messages(spark):
    schema = spark.sql("SELECT 1").limit(0).schema.fromDDL(chat.FIELDS)
    rows = spark.createDataFrame([tuple(case.get(f.name) for f in schema) for case, *_ in CASES], schema).withColumn("i", F.monotonically_increasing_id()).coalesce(1)
    got = rows.select("i", "event", chat.slack().alias("slack"), chat.discord().alias("discord"), chat.dingtalk().alias("ding")).orderBy("i").collect()
    for r, (case, slack, discord, ding) in zip(got, CASES, strict=True):
        assert r.slack.text == slack, case
        assert r.discord.description == discord, case
        assert ding is None or r.ding.text == ding, case
    by = {(c["event"], c.get("action")): r for r, (c, *_) in zip(got, CASES)}
    assert by["issues", "opened"].slack.title == LINK and by["issues", "opened"].slack.attachment == "x &amp; y" and by["issues", "closed"].slack.title == ""
    assert by["push", None].slack.attachment == "<https://c/1|0123456>: one - Ann"
    comment = by["issue_comment", "created"]
    assert comment.slack.title == "<https://g/u/site/issues/7#issuecomment-3|#7 a &lt; b>" and comment.discord.title == "New comment: #7 a < b" and comment.discord.url.endswith("#issuecomment-3") and comment.ding.button == "View Issue Comment"
    assert [(f.name, f.value) for f in by["issues", "label_updated"].discord.fields] == [("Labels", "<empty>")]
    assert [(f.name, f.value) for f in by["issues", "assigned"].discord.fields] == [("New Assignee", "bob")] and by["issues", "assigned"].discord.footer == "u/site"
    assert by["create", None].discord.url == "https://g/ann" and by["create", None].ding.button == "View Branch" and by["create", None].ding.button_url == "https://g/u/site/src/dev"
    colours = spark.createDataFrame([("#ff0000",), ("00ff",), ("red",), ("",)], "c string").select(chat.colour(F.col("c")).alias("n")).collect()
    assert [r.n for r in colours] == [0xFF0000, 0xFF, 0, 0]


TEXTS = {
    "Shift_JIS": "これは日本語のテキストです。とてもかんたんな文章です。",
    "EUC-JP": "これは日本語のテキストです。とてもかんたんな文章です。",
    "EUC-KR": "이것은 한국어로 된 간단한 문장입니다. 그리고 하나 더 있습니다.",
    "GB18030": "这是我们的国家，他们在这里说话，也会来的。",
    "Big5": "這是我們的國家，他們在這裡說話，也會來的。",
    "windows-1251": "Это простой текст на русском языке, и в нём есть несколько слов.",
    "KOI8-R": "Это простой текст на русском языке, и в нём есть несколько слов.",
    "windows-1252": "Où est le garçon ? Il a mangé – hier – à l’école, très tôt.",
    "UTF-8": "Ünïcödé 漢字",
    "UTF-16LE": "﻿abc漢",
    "ISO-2022-JP": "これは日本語です",
}


def test_charsets(spark):
    rows = [(name, bytearray(text.encode(name)), text.removeprefix("﻿")) for name, text in TEXTS.items()]
    rows += [("UTF-8", bytearray(b""), ""), ("UTF-8", bytearray(b"plain"), "plain"), ("UTF-8", bytearray(b"\xef\xbb\xbfmarked"), "marked"), (None, None, None)]
    got = spark.createDataFrame(rows, "name string, content binary, text string").select("*", charset.charset(F.col("content")).alias("found"), charset.text_of(F.col("content")).alias("read")).collect()
    for r in got:
        assert r.found == (r.name if r.content is not None else None) and r.read == r.text, r
    assert charset.to_utf8("ÄÖ".encode("latin-1"), "ISO-8859-1") == "ÄÖ" and "�" in charset.to_utf8(b"\x81\x8d\x8f", "windows-1252")


def test_registered_functions(spark):
    names = register.register(spark)
    assert register.register(spark) == names
    r = spark.sql("SELECT site_short_sha('0123456789abc') AS a, site_ellipsis('abcdef', 3) AS b, site_first_text('', 'x') AS c, site_percent(1, 3) AS d, site_percent(1, 0) AS e, site_escape_pound('a b#%?') AS f, site_email_hash(' A@b ') = md5('a@b') AS g, site_access_name(3) AS h, site_version_compare('1.10.0', '>', '1.9') AS i, site_sanitise('<b>x</b><script>y</script>') AS j, site_short_ref('refs/heads/x/y') AS k").first()
    assert tuple(r)[:9] == ("0123456789", "abc...", "x", 33, 0, "a%20b%23%25%3F", True, "admin", True) and "script" not in r.j and r.k == "x/y"
    assert {f.name for f in spark.catalog.listFunctions() if f.name.startswith("site_")} == set(names)


def test_random_text(spark):
    rows = [r.x for r in spark.range(500).select(T.random_text(12, 3).alias("x")).collect()]
    assert len(set(rows)) == 500 and all(len(x) == 12 and x.isalnum() for x in rows)


def test_exclusion(spark):
    draw = random.Random(1)
    rows = [(i, draw.randrange(4), draw.randrange(60), draw.randrange(1, 9)) for i in range(200)]
    got = {r.id: (r.started, r.ended) for r in flows.exclusive(spark.createDataFrame(rows, "id bigint, key bigint, at bigint, takes bigint"), "key", "at", "takes", "id").collect()}
    free = {}
    for i, key, at, takes in sorted(rows, key=lambda r: (r[2], r[0])):
        started = max(at, free.get(key, at))
        free[key] = started + takes
        assert got[i] == (started, started + takes)


def test_cursor_and_blobs(spark, tmp_path):
    import hashlib

    assert [r.id for r in archive.rows(spark.range(100).repartition(7), "id")] == list(range(100))
    for body in (b"abc", b"x" * 3_000_000):
        name = hashlib.sha256(body).hexdigest()
        (tmp_path / name[0]).mkdir(exist_ok=True)
        (tmp_path / name[0] / name).write_bytes(body)
    (tmp_path / "bad").write_bytes(b"no")
    (tmp_path / ("0" * 64)).write_bytes(b"y" * 2000)
    want = {(hashlib.sha256(b).hexdigest(), len(b), True) for b in (b"abc", b"x" * 3_000_000)} | {("bad", 2, False), ("0" * 64, 2000, False)}
    for whole in (64 << 20, 1000):
        assert {tuple(r) for r in archive.blobs(spark, str(tmp_path), whole).collect()} == want


def test_archive_of_a_site(spark, tmp_path):
    for name in ("custom/conf/app.ini", "data/avatars/1", "repositories/ann/a.git/HEAD", "repositories/ann/mirror.git/HEAD", "repositories/ann/mirrored.git/HEAD"):
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_text(name)
    parts = {n: str(tmp_path / "site" / n) for n in ("custom", "data", "repositories")}
    follow = spark.createDataFrame([(1, 2, 3), (2, 3, 4)], "id bigint, user_id bigint, follow_id bigint")
    for i, (options, files) in enumerate([({}, 5), ({"database_only": True}, 0), ({"exclude_repositories": True}, 2), ({"exclude_mirrors": True, "mirrors": ("ann/mirror",)}, 4)]):
        archive.pack({"follow": follow}, str(tmp_path / f"dump{i}"), str(tmp_path / f"{i}.zip"), parts, version="1", **options)
        tables, beside = archive.unpack(spark, str(tmp_path / f"{i}.zip"), str(tmp_path / f"out{i}"))
        assert sorted(map(tuple, tables["follow"].collect())) == [(1, 2, 3), (2, 3, 4)]
        found = [p for n in beside for p in (tmp_path / f"out{i}" / n).rglob("*") if p.is_file()]
        assert len(found) == files and all(p.read_text() == str(p.relative_to(tmp_path / f"out{i}")) for p in found)
    import zipfile

    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../outside", "x")
    with pytest.raises(ValueError):
        archive.unpack(spark, str(tmp_path / "bad.zip"), str(tmp_path / "bad"))
