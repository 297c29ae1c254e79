"""What the operators share: the shared folder, written intermediate tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeframe.session import shared_dir

#: Characters of a word: all but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Folders of this process's operator calls, which their results may still read.
MADE: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the folders of all operator calls so far: for callers that have written the results that they need."""
    while MADE:
        delete(spark, MADE.pop())


class Scratch:
    """A folder of one operator call in the shared folder; its tables cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        MADE.append(self.path)

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Writes ``df`` and reads it again."""
        at = posixpath.join(self.path, name)
        df.write.mode("overwrite").option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """Deletes a table that no later step reads, or all of them."""
        delete(self.spark, posixpath.join(self.path, name) if name else self.path)


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; at its end, memory that was freed goes back to the system, as workers live on for other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[list]], list[list]]], block_bytes: int = 4 << 20, through: int = 0, read: list[int] | None = None) -> DataFrame:
    """``df`` through ``mapInArrow``: ``make()`` runs once a task and gives a function from
    columns (lists) to columns (lists). The first ``through`` columns, of any type, stay as they
    are and are not given to it; it then returns as many rows as it gets. ``read``: places of the columns that are
    given to it instead of those after ``through``, so that a text that stays need not be sent twice. Rows are handed
    over in blocks of about ``block_bytes`` of strings, so long texts do not pile up in a Python worker.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows, step = batch.num_rows, max(1, batch.num_rows)
            if batch.nbytes > block_bytes:
                step = max(1, int(rows * block_bytes / batch.nbytes))
            for at in range(0, rows, step):
                part = batch.slice(at, step)
                out = f([part.column(i).to_pylist() for i in (range(through, part.num_columns) if read is None else read)])
                whole = [c if c.type == t.type else c.cast(t.type) for c, t in zip(part.columns[:through], target)]
                made = [pa.array(c, t.type) for c, t in zip(out, list(target)[through:], strict=True)]
                yield pa.RecordBatch.from_arrays([*whole, *made], schema=target)

    return df.mapInArrow(tidied(run), schema)


def crc_mod(column: str, by: int):
    """crc32 of the column as text, modulo ``by``; a null column counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))
