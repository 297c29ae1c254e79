from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forgeframe.functions import html as H
from forgeframe.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, names",
    [("@user cc @user2 on @name3", ["user", "user2", "name3"]), ("hello", []), ("mail a@b.c", []), ("(@x-1.y)!", ["x-1.y"])],
)
def test_mentions(spark, text, names):
    assert one(spark, T.mentions(F.lit(text))) == names


@pytest.mark.parametrize(
    "text, want",
    [
        ("#123", '<a href="/p/issues/123">#123</a>'),
        ("a (#1) [#2 x#3 #4a", 'a (<a href="/p/issues/1">#1</a>) [<a href="/p/issues/2">#2</a> x#3 #4a'),
        ("none", "none"),
    ],
)
def test_issue_links(spark, text, want):
    assert one(spark, T.issue_links(F.lit(text), "/p")) == want


def test_other_trackers(spark):
    assert one(spark, T.issue_links(F.lit("see ABC-12"), "/p", "alphanumeric", "https://t/{index}")) == 'see <a href="https://t/ABC-12">ABC-12</a>'
    assert one(spark, T.issue_links(F.lit("see #12"), "/p", external="https://t/{index}")) == 'see <a href="https://t/12">#12</a>'


def test_sha_links(spark):
    sha = "d8a994ef243349f321568f9e36d5c3f444b99cae"
    assert one(spark, T.sha_links(F.lit(f"x {sha}, 1234567 end"), "/r")) == f'x <a href="/r/commit/{sha}"><code>d8a994ef24</code></a>, 1234567 end'
    assert one(spark, T.sha_links(F.lit("test"), "/r")) == "test"


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://s/a/b/commit/d8a994ef243349f321568f9e36d5c3f444b99cae#diff-2", ' <code><a href="https://s/a/b/commit/d8a994ef243349f321568f9e36d5c3f444b99cae#diff-2">d8a994ef24</a></code>'),
        ("https://s/a/b/issues/4#issue-685", '<a href="https://s/a/b/issues/4#issue-685">#4</a>'),
        ("https://s/x/y/issues/7", '<a href="https://s/x/y/issues/7">x/y#7</a>'),
        ("https://s/x/y", '<a href="https://s/x/y">https://s/x/y</a>'),
        ("http://other/a/b/issues/1", '<a href="http://other/a/b/issues/1">http://other/a/b/issues/1</a>'),
    ],
)
def test_auto_links(spark, url, want):
    assert one(spark, T.auto_link(F.lit(url), "https://s/", "/a/b")) == want


def test_special_links_agree(spark):
    text = "@ann (#5) see bob/site#9 at deadbeef0 and 7654321 by @ann"
    assert one(spark, T.special_links(F.lit(text), "/p", "/r", "https://s/")) == H.special_links(text, "/p", "/r", "https://s/")


def test_references(spark):
    message = "Fixes #3, closes bob/x#4 and prefixes me#5; fix nothing; resolve #0 #77"
    assert one(spark, T.references(F.lit(message), T.CLOSE, "ann/y")) == ["ann/y#3", "bob/x#4"]
    assert one(spark, T.references(F.lit(message), T.REFERENCE, "ann/y")) == ["ann/y#3", "bob/x#4", "ann/y#77"]
    assert one(spark, T.reference(F.lit("a/b#12"))) == ("a", "b", 12)
    assert one(spark, T.reference(F.lit("a/b#0"))) is None


def test_mirror_updates(spark):
    log = """From https://example.com/x
 * [new branch]      bar1       -> bar1
   e0639e38fb..6db2410489  foo -> foo
 - [deleted]         (none)     -> bar2
 t [tag]             v1         -> v1"""
    got = [tuple(r) for r in one(spark, T.mirror_updates(F.lit(log)))]
    assert got == [("bar1", "0000000", ""), ("foo", "e0639e38fb", "6db2410489"), ("bar2", "", "0000000")]


@pytest.mark.parametrize("n, want", [(0, "0 B"), (9, "9 B"), (10, "10 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (10240, "10 KB"), (1024**2, "1.0 MB"), (5 * 1024**4, "5.0 TB")])
def test_file_size(spark, n, want):
    assert one(spark, T.file_size(F.lit(n).cast("bigint"))) == want


@pytest.mark.parametrize("d, one_unit, all_units", [(0, "now", ""), (1, "1 second", "1 second"), (59, "59 seconds", "59 seconds"), (3661, "1 hour", "1 hour, 1 minute, 1 second"), (31104000 + 86400, "1 year", "1 year, 1 day"), (2 * 31104000 + 86400, "2 years", "2 years"), (-5, "now", "future")])
def test_intervals(spark, d, one_unit, all_units):
    c = F.lit(d).cast("bigint")
    assert (one(spark, T.one_unit(c)), one(spark, T.all_units(c))) == (one_unit, all_units)


def test_codes(spark):
    at = F.lit(datetime(2024, 1, 1, 10, 0))
    code = T.time_limited_code(F.lit("7ann"), at, F.lit(30), "key")
    text = one(spark, code)
    assert len(text) == 58 and text.startswith("202401011000000030")
    valid = lambda c, now: one(spark, T.code_is_valid(F.lit(c), F.lit("7ann"), F.lit(now), "key"))
    assert valid(text, datetime(2024, 1, 1, 10, 29)) and not valid(text, datetime(2024, 1, 1, 10, 31)) and not valid(text[:-1] + "x", datetime(2024, 1, 1, 10, 1)) and not valid("", datetime(2024, 1, 1))


def test_nulls(spark):
    none = F.lit(None).cast("string")
    for f in (T.mentions, T.shas, T.mirror_updates, T.short_sha, T.email_hash, T.clean_path, T.line_breaks):
        assert one(spark, f(none)) is None
    assert one(spark, T.first_text(none, F.lit(""), F.lit("x"))) == "x"
    assert one(spark, H.udf(H.sanitised)(none)) is None


def test_html():
    linked = H.linked_html('<p>#1 <code>#2</code> <a href="x">#3</a><img src="i.png" alt="a"></p>', "/u/r/src/main", "/u/r")
    assert linked == '<p><a href="/u/r/src/main/issues/1">#1</a> <code>#2</code> <a href="x">#3</a><a href="/u/r/raw/main/i.png"><img src="/u/r/raw/main/i.png" alt="a"></a></p>'
    assert H.sanitised('<a onblur="alert(1)" href="http://www.google.com">G</a>') == '<a href="http://www.google.com" rel="nofollow">G</a>'
    assert H.sanitised('<script>x</script><code class="language-go">a</code><code class="random">b</code>') == '<code class="language-go">a</code><code>b</code>'
    assert H.sanitised('<img src="data:text/html;base64,PHN">') == "" and "data:image/png" in H.sanitised('<img src="data:image/png;base64,x">')
    assert H.sanitised('<input type="hidden">') == "" and H.sanitised('<input type="checkbox">') == '<input type="checkbox">'
    assert "<h1>T</h1>" in H.markdown("# T") and 'checked=""' in H.markdown("- [x] a")


def test_diffs():
    assert H.inline_diff("foo bar", "foo baz", "add") == '+foo ba<span class="added-code">z</span>'
    assert H.inline_diff("foo bar", "foo baz", "delete") == '-foo ba<span class="removed-code">r</span>'
    rows = H.diff_lines("diff --git a/x b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n", lines=2)
    assert [(r["kind"], r["left"], r["right"], r["content"]) for r in rows] == [("delete", 1, 0, "a"), ("add", 0, 1, "b")]


def test_versions_and_hosts():
    assert H.version_compare("1.2.3", "<", "1.10.0") and H.version_compare("2.0.0-rc1", "<", "2.0.0") and not H.version_compare("x", "=", "1") and H.version_compare("2.1.0.windows.1", ">=", "2.1")
    assert H.blocked_address("127.0.0.1") and H.blocked_address("::1") and not H.blocked_address("8.8.8.8") and not H.blocked_address("10.0.0.1", ("10.0.0.1",))
    assert H.file_kind(b"") == "text" and H.file_kind(b"\x00\x01") == "binary" and H.file_kind(b"%PDF-1") == "pdf"


def test_links_stand_at_their_places(spark):
    """Equal and overlapping names, and names that look like commits, give no link inside another one."""
    link = lambda to, label: f'<a href="{to}">{label}</a>'
    cases = {
        "@ann @anna @ann": " ".join(link(f"/{n}", f"@{n}") for n in ("ann", "anna", "ann")),
        "#1 #12 (#1)": f"{link('/p/issues/1', '#1')} {link('/p/issues/12', '#12')} ({link('/p/issues/1', '#1')})",
        "@deadbeef1 a/b#7 a/b#7": f"{link('/deadbeef1', '@deadbeef1')} {link('https://s/a/b/issues/7', 'a/b#7')} {link('https://s/a/b/issues/7', 'a/b#7')}",
        "deadbeef12345": '<a href="/r/commit/deadbeef12345"><code>deadbeef12</code></a>',
        "x": "x",
        "": "",
    }
    for text, want in cases.items():
        assert H.special_links(text, "/p", "/r", "https://s/") == want
        assert one(spark, T.special_links(F.lit(text), "/p", "/r", "https://s/")) == want


def test_signatures(spark):
    import hashlib
    import hmac

    for secret in ("k", "", "é" * 10, "x" * 64, "y" * 65, "z" * 200):
        for payload in ("", "p", '{"a": "ü"}' * 50):
            assert one(spark, T.hmac_sha256(F.lit(payload), *T.hmac_keys(F.lit(secret)))) == hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


def test_file_kinds_are_those_of_python(spark):
    heads = [b"", b"text", b"a\tb\n\x1b[0m", b"\x00", b"ab\x1c", b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff", b"GIF89a", b"BMx", b"%PDF-1", b"\x1aE\xdf\xa3", b"OggS", b"RIFF1234WEBPx", b"RIFF1234AVI x", b"1234ftypmp42", b"a" * 1024 + b"\x00", "é漢".encode()]
    rows = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, h binary").select("i", T.file_kind(F.col("h")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: H.file_kind(h) for i, h in enumerate(heads)}


def test_passwords():
    stored = H.password_hash("secret", "salt")
    assert len(stored) == 100 and H.password_matches("secret", "salt", stored)
    assert not H.password_matches("secret", "Salt", stored) and not H.password_matches("", "salt", stored) and not H.password_matches("secret", "salt", "")
