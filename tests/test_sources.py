import hashlib
import json

import pytest

from forgeframe.sources import archive, schema


def test_schemas(spark):
    assert len(schema.TABLES) == 37
    for name in schema.TABLES:
        kinds = schema.schema(name)
        assert len(set(kinds.names)) == len(kinds.names)
        for c in kinds.names:
            assert schema.column(name, schema.field(name, c)) == c
    assert schema.field("action", "act_user_id") == "ActUserID" and schema.field("lfs_object", "oid") == "OID"


def test_dump_and_restore(spark, tmp_path):
    rows = [(2, 1, "b\x00c", 5), (1, 3, "é\n", 0)]
    follow = spark.createDataFrame([(i, a, b) for i, a, b in ((3, 1, 2), (1, 2, 1))], schema.schema("follow"))
    notice = spark.createDataFrame([(i, t, d, c) for i, t, d, c in rows], schema.schema("notice"))
    archive.dump_all({"follow": follow, "notice": notice}, str(tmp_path), app="1")
    lines = [json.loads(x) for f in (tmp_path / "db/Follow.json").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"ID": 1, "UserID": 2, "FollowID": 1}, {"ID": 3, "UserID": 1, "FollowID": 2}]
    again = archive.restore_all(spark, str(tmp_path))
    assert [tuple(r) for r in again["notice"].orderBy("id").collect()] == [(1, 3, "é\n", 0), (2, 1, "bc", 5)]
    assert archive.restore(spark, "star", str(tmp_path)).count() == 0
    assert archive.next_id(again["follow"]).first().next_id == 4
    assert archive.next_id(again["follow"].limit(0)).first().next_id == 1


def test_label_templates(spark):
    good = spark.createDataFrame([("#ff0000 bug; Something is broken",), ("",), ("#00ff00 help wanted",)], "value string")
    assert [tuple(r) for r in archive.label_templates(good).collect()] == [("#ff0000", "bug", "Something is broken"), ("#00ff00", "help wanted", "")]
    with pytest.raises(Exception, match="malformed"):
        archive.label_templates(good.unionAll(spark.createDataFrame([("nope",)], "value string"))).collect()


def test_keys_and_blobs(spark, tmp_path):
    keys = spark.createDataFrame([(1, "ssh-rsa A\n"), (2, "ssh-rsa B")], "id bigint, content string")
    lines = [r.value for r in archive.authorized_keys(keys, "/bin/serve").collect()]
    assert lines[0].endswith("ssh-rsa B") and "key-2" in lines[0] and lines[1].endswith("ssh-rsa A")
    good = hashlib.sha256(b"x").hexdigest()
    (tmp_path / good).write_bytes(b"x")
    (tmp_path / ("0" * 64)).write_bytes(b"yy")
    assert {(r.oid, r["size"], r.sound) for r in archive.blobs(spark, str(tmp_path)).collect()} == {(good, 1, True), ("0" * 64, 2, False)}


def test_small_helpers():
    assert archive.host_and_port("") == ("127.0.0.1", "5432")
    assert archive.host_and_port("db:15") == ("db", "15") and archive.host_and_port("[::1]:7") == ("[::1]", "7") and archive.host_and_port("[::1]") == ("[::1]", "5432")
    rows = archive.login_source_rows({"a.conf": "id=101\ntype=ldap_bind_dn\nname=LDAP\nis_activated=true\n[config]\nhost=h\n", "b.txt": ""})
    assert rows == [{"id": 101, "type": "ldap_bind_dn", "name": "LDAP", "is_actived": True, "is_default": False, "cfg": '{"host": "h"}'}]


def test_counts(spark):
    got = archive.counts({"a": spark.range(3), "b": spark.range(0)})
    assert {(r.name, r.n) for r in got.collect()} == {("a", 3), ("b", 0)}
