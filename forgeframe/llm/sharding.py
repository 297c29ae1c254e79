"""Minimax contiguous partition of atomic groups into shards (operator 2).

Equal texts form one atomic group. Groups stand in the order of a 60-bit hash of the text (two
texts of one hash form one group, which is harmless). The smallest capacity for which the
greedy cut needs no more than ``shards`` shards is found by binary search, exactly, without
collecting the groups: the driver holds sums over hash ranges (2**14 at first). Ranges taken
as indivisible give an upper bound of the capacity, taken as fluid a lower bound; only the few
ranges that a cut falls in are summed again in finer ranges, until both bounds meet. A round
reads one narrow table; their number depends on the 60 bits, not on the rows.

Slots are numbered in cells of (shard, hash range, salt), so one huge group is spread over
``SALTS`` cells; cells get their offsets from a table of at most 2**16 + 7 * SALTS counts.

DataFrame functions only. Null texts are one group of size 1 a row with a null checksum; empty
texts have size 1. Repeated rows each get a slot. Fewer groups than shards: shards stay empty.
An empty table gives an empty result. Texts are hashed and measured whole where they lie, however long, and
not moved. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forgeframe.llm._common import Scratch

BITS, FIRST, FINER, CELL_BITS, SALTS = 60, 14, 8, 10, 64


def hash60(column) -> F.Column:
    """The first 60 bits of the column's MD5; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(column.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


class Range:
    """Hashes from ``low`` whose first ``bits`` bits agree: their rows' size, and whether they are one group."""

    __slots__ = ("low", "bits", "size", "one")

    def __init__(self, low: int, bits: int, size: int, one: bool):
        self.low, self.bits, self.size, self.one = low, bits, size, one or bits >= BITS


def cuts(ranges: list[Range], capacity: int, fluid: bool) -> list[int] | None:
    """Where the greedy cut begins shards after the first (indexes of ranges); None if a group is too large.

    fluid: ranges of several groups may be cut anywhere; a cut inside one has that range's index.
    """
    found, left = [], capacity
    for i, r in enumerate(ranges):
        size = r.size
        if size <= left:
            left -= size
        elif fluid and not r.one:
            size -= left
            more = -(-size // capacity)
            found += [i] * more
            left = more * capacity - size
        else:
            if size > capacity:
                return None
            found.append(i)
            left = capacity - size
    return found


def smallest(ranges: list[Range], shards: int, fluid: bool) -> int:
    """The least capacity for which ``shards`` shards suffice."""
    low, high = 0, max(1, sum(r.size for r in ranges))
    while high - low > 1:
        middle = (low + high) // 2
        at = cuts(ranges, middle, fluid)
        low, high = (low, middle) if at is not None and len(at) < shards else (middle, high)
    return high


def summed(rows: DataFrame, bits: int) -> list[Range]:
    step = 1 << (BITS - bits)
    found = rows.groupBy(F.floor(F.col("h") / step).cast("bigint").alias("p") if step > (1 << 53) else F.expr(f"h div {step}").alias("p")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("most")).collect()
    return [Range(x.p * step, bits, x["size"], x.least == x.most) for x in found]


def boundaries(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the hashes at which shards 1, 2, ... begin. rows: (h, size)."""
    ranges = sorted(summed(rows, FIRST), key=lambda r: r.low)
    if not ranges:
        return 0, []
    while True:
        high, low = smallest(ranges, shards, False), smallest(ranges, shards, True)
        if high == low:
            return high, [ranges[i].low for i in cuts(ranges, high, False)]
        near = {j for i in cuts(ranges, low, True) for j in range(max(0, i - 4), min(len(ranges), i + 5))}
        finer: dict[int, list[Range]] = {}
        for i in near:
            if not ranges[i].one:
                finer.setdefault(ranges[i].bits, []).append(ranges[i])
        gone = {id(r) for rs in finer.values() for r in rs}
        ranges = [r for r in ranges if id(r) not in gone]
        for bits, rs in finer.items():
            step = 1 << (BITS - bits)
            ranges += summed(rows.filter(F.expr(f"h div {step}").isin([r.low // step for r in rs])), min(BITS, bits + FINER))
        ranges.sort(key=lambda r: r.low)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot of each row, for a writer that puts rows in their places."""
    scratch = Scratch(docs.sparkSession, "sharding")
    t = F.col(text)
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        hash60(t).alias("h"),
        F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(SALTS)).alias("salt"),
    )
    rows = scratch.table(rows, "rows")
    _, begins = boundaries(rows.select("h", "size"), shards)
    where = sum((F.when(F.col("h") >= F.lit(b), 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    rows = rows.withColumns({"shard": where, "cell": F.expr(f"h div {1 << (BITS - CELL_BITS)}")})
    cell = ["shard", "cell", "salt"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell", "salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy(*cell).orderBy("h", "key", "size", "text_crc32"))
    return rows.withColumn("place", place).join(F.broadcast(offsets), cell).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot"))
