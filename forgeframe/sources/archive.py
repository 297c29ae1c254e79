"""Tables in and out: JSON Lines archives, text sources and sinks, content-addressed blobs."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from forgeframe.sources import schema as S


def key_of(table: str) -> list[str]:
    return ["repo_id", "oid"] if table == "lfs_object" else ["id"]


def dump(df: DataFrame, table: str, folder: str, single: bool = False) -> None:
    """Writes ``folder/<Table>.json`` as JSON Lines in key order.

    One file a partition, globally ordered; ``single``: one file through one task, for small
    tables that other programs read.
    """
    named = df.orderBy(*key_of(table)).select(*[F.col(c).alias(S.field(table, c)) for c in df.columns])
    (named.coalesce(1) if single else named).write.mode("overwrite").option("ignoreNullFields", "false").json(posixpath.join(folder, f"{S.archive_name(table)}.json"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def restore(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Reads a table of an archive with its declared types; a missing file gives an empty table.

    Text fields lose NUL characters, which the archive's databases can't hold. Broken lines give rows of nulls.
    """
    kinds = S.schema(table)
    at = posixpath.join(folder, f"{S.archive_name(table)}.json")
    if not exists(spark, at):
        return spark.createDataFrame([], kinds)
    named = StructType([StructField(S.field(table, f.name), f.dataType) for f in kinds])
    rows = spark.read.schema(named).json(at)
    text = lambda f: F.regexp_replace(F.col(S.field(table, f.name)), "\\x00", "") if f.dataType.typeName() == "string" else F.col(S.field(table, f.name))
    return rows.select(*[text(f).alias(f.name) for f in kinds])


def dump_all(tables: dict[str, DataFrame], folder: str, **meta) -> dict:
    """Every table and a manifest of what the archive holds."""
    for name, df in tables.items():
        dump(df, name, posixpath.join(folder, "db"))
    manifest = {"format": 1, "tables": sorted(tables), **meta}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(posixpath.join(folder, "manifest"))
    return manifest


def restore_all(spark: SparkSession, folder: str, only_database: bool = True) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(posixpath.join(folder, "manifest")).first().value)
    if manifest["format"] != 1:
        raise ValueError(f"archive format {manifest['format']}")
    return {name: restore(spark, name, posixpath.join(folder, "db")) for name in manifest["tables"]}


#: What an archive may hold beside the tables, and the option that leaves it out.
PARTS = {"custom": "database_only", "data": "database_only", "repositories": "exclude_repositories"}


def pack(tables: dict[str, DataFrame], folder: str, zip_path: str, parts: dict[str, str] | None = None, database_only: bool = False, exclude_repositories: bool = False, exclude_mirrors: bool = False, mirrors: tuple[str, ...] = (), **meta) -> dict:
    """The zip of a whole site (S5): the dump of all tables, the manifest, and folders of files.

    Tables are dumped by Spark into ``folder``, a path that the driver has mounted; the driver then copies
    files into the zip one by one, never whole in memory. parts: folders for ``custom``, ``data`` and
    ``repositories``; mirrors: repositories (owner/name) that ``exclude_mirrors`` leaves out.
    """
    import os
    import zipfile

    left_out = {"database_only": database_only, "exclude_repositories": exclude_repositories or database_only}
    taken = {name: at for name, at in (parts or {}).items() if not left_out[PARTS[name]]}
    manifest = dump_all(tables, folder, parts=sorted(taken), **meta)
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name, at in [("", folder), *taken.items()]:
            for d, _, files in sorted(os.walk(at)):
                inside = os.path.relpath(d, at)
                gone = name == "repositories" and exclude_mirrors and any(f"{inside}/".startswith(m + suffix) for m in mirrors for suffix in ("/", ".git/"))
                for f in [] if gone else sorted(files):
                    if not f.endswith(".crc") and f != "_SUCCESS":
                        z.write(os.path.join(d, f), os.path.normpath(os.path.join(name, inside, f)))
    return manifest


def unpack(spark: SparkSession, zip_path: str, folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of a ``pack`` and the folders beside them, unzipped into ``folder``; refuses names that lead out of it."""
    import os
    import zipfile

    with zipfile.ZipFile(zip_path) as z:
        for name in z.namelist():
            if not os.path.realpath(os.path.join(folder, name)).startswith(os.path.realpath(folder) + os.sep):
                raise ValueError(f"the archive has a file outside of its folder: {name}")
        z.extractall(folder)
    manifest = json.loads(spark.read.text(posixpath.join(folder, "manifest")).first().value)
    return restore_all(spark, folder), manifest.get("parts", [])


def next_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: the value that a sequence goes on with."""
    return df.agg(F.coalesce(F.max(key) + 1, F.lit(1)).cast("bigint").alias("next_id"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables in one job; Parquet footers answer most of it."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def label_templates(lines: DataFrame) -> DataFrame:
    """(color, name, description) from lines ``#rrggbb name; description`` (column value). Blank lines are skipped, others that don't fit raise."""
    value = F.trim("value")
    pattern = r"^(#[0-9a-fA-F]{6})\s+([^;]+?)\s*(?:;\s*(.*))?$"
    rows = lines.filter(value != "")
    bad = F.when(~value.rlike(pattern), F.raise_error(F.concat(F.lit("malformed label line: "), value)))
    return rows.select(F.coalesce(bad, F.regexp_extract(value, pattern, 1)).alias("color"), F.regexp_extract(value, pattern, 2).alias("name"), F.regexp_extract(value, pattern, 3).alias("description"))


def authorized_keys(keys: DataFrame, command: str) -> DataFrame:
    """(value): one line for each public key, newest first, ready for a text sink."""
    line = F.concat(F.lit(f'command="{command} serv key-'), F.col("id").cast("string"), F.lit('",no-port-forwarding,no-X11-forwarding,no-agent-forwarding,no-pty '), F.regexp_replace("content", r"^\s+|\s+$", ""))
    return keys.orderBy(F.desc("id")).select(line.alias("value"))


def rows(df: DataFrame, *order: str):
    """A cursor (S6): rows in order, one partition at a time at the driver and the next one fetched ahead."""
    return (df.orderBy(*order) if order else df).toLocalIterator(prefetchPartitions=True)


def blobs(spark: SparkSession, folder: str, whole: int = 64 << 20) -> DataFrame:
    """(oid, size, sound) of content-addressed files: sound if the name is the content's SHA-256.

    Files of up to ``whole`` bytes are read by Spark; of larger ones only the paths are, and tasks read them
    piece by piece. Spark's readers skip empty files, so there is no row for them.
    """

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        from hashlib import sha256

        from pyarrow import fs

        def one(uri: str) -> str:
            store, path = fs.FileSystem.from_uri(uri)
            found = sha256()
            with store.open_input_stream(path) as f:
                while piece := f.read(1 << 20):
                    found.update(piece)
            return found.hexdigest()

        return paths.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    oid = F.element_at(F.split("path", "/"), -1)
    small = files.filter(F.col("length") <= whole).select(oid.alias("oid"), F.col("length").alias("size"), (F.sha2("content", 256) == oid).alias("sound"))
    large = files.filter(F.col("length") > whole).select(oid.alias("oid"), F.col("length").alias("size"), (digest(F.regexp_replace("path", "^file:/+", "file:///")) == oid).alias("sound"))
    return small.unionByName(large)


def valid_oid(c):
    """64 lower-case hexadecimal digits."""
    return F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def jdbc(spark: SparkSession, dialect: str, host: str, database: str, table: str, user: str = "", password: str = "", partition: tuple[str, int, int, int] | None = None, path: str = "") -> DataFrame:
    """A table of a PostgreSQL, MySQL or SQLite database; (column, lowest, highest, parts) reads it in parallel."""
    url = {"postgres": f"jdbc:postgresql://{host}/{database}", "mysql": f"jdbc:mysql://{host}/{database}", "sqlite3": f"jdbc:sqlite:{path}"}[dialect]
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password)
    if partition:
        c, low, high, n = partition
        reader = reader.options(partitionColumn=c, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def host_and_port(info: str) -> tuple[str, str]:
    """Host and port of a PostgreSQL address; IPv6 in brackets, sockets by path, defaults 127.0.0.1 and 5432."""
    host, port = "127.0.0.1", "5432"
    if ":" in info and not info.endswith("]"):
        at = info.rindex(":")
        host, port = info[:at], info[at + 1 :]
    elif info:
        host = info
    return host or "127.0.0.1", port or "5432"


def login_source_rows(texts: dict[str, str]) -> list[dict]:
    """Rows of login-source files (INI text by name): the keys of the head, and the rest of ``[config]`` as JSON."""
    import configparser

    out = []
    for name, text in sorted(texts.items()):
        if not name.endswith(".conf"):
            continue
        ini = configparser.ConfigParser()
        ini.optionxform = str
        ini.read_string("[_]\n" + text)
        head = ini["_"]
        config = dict(ini["config"]) if ini.has_section("config") else {}
        flag = lambda k: head.get(k, "false").strip().lower() in ("true", "1", "yes", "on")
        out.append({"id": int(head["id"]), "type": head["type"], "name": head["name"], "is_actived": flag("is_activated"), "is_default": flag("is_default"), "cfg": json.dumps(config, sort_keys=True)})
    return out
