"""Mixing sources to target weights (operator 3).

Each row gets a hash-random key; rows stand in key order within their source. Sums of sizes
over cells of (source, top key bits) give every cell its offset, a running sum inside the cell
gives every row its own: prefix sums without one task holding a source. The mix takes whole
epochs of a source and then a prefix of its key order, cut at the exact budget.

Targets: a source's weight share of ``share`` times all sizes, at most ``cap`` times its own
size, the excess shared again by weight until none is above. That fixed point is
``min(level * weight, cap * size)`` with one common level, found from sums over sources sorted
by cap / weight.

Null sources are one source, the last; null keys share one hash; null and empty texts have
size 0 and are never cut. Equal keys are ordered by size; where very many rows have one key, first
by a hash of size and text, in ``SALTS`` cells, so that they are not one task. Only sizes of texts
are moved, however long they are. Targets take one row a source. Empty table: empty result. Input
columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forgeframe.llm._common import WORD, Scratch, fresh
from forgeframe.llm.sharding import BITS, hash60

#: Bits of a key's hash that name a cell; cells of a hot key; the share of all rows that makes a key hot.
CELL_BITS, SALTS, HOT = 12, 256, 10_000


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(s, none, source_size) with target: sources in code-point order, null last, weights in turn."""
    first = W.orderBy("none", "s")
    rows = sources.withColumn("i", F.pmod(F.row_number().over(first) - 1, F.lit(len(weights))))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("i") + 1)
    rows = rows.withColumns({"w": w, "most": F.lit(float(cap)) * F.col("source_size")}).withColumn("ratio", F.col("most") / F.col("w"))
    by = W.orderBy("ratio", "none", "s")
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
        "all": F.sum("source_size").over(W.partitionBy()),
    })
    level = (F.lit(float(share)) * F.col("all") - F.col("capped")) / F.col("open")
    first_fit = F.when(level <= F.col("ratio"), F.struct(F.row_number().over(by).alias("i"), level.alias("level")))
    rows = rows.withColumn("fit", first_fit).withColumn("level", F.min("fit").over(W.partitionBy())["level"])
    return rows.select("s", "none", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("most")), F.col("most")).alias("target"))


def plan(docs: DataFrame, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0, key="doc_id", source="source", text="text", scratch: Scratch | None = None) -> DataFrame:
    """key, source, size, source_size, target, k (random key), before (words of its source ahead of it), epochs, rest, taken."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("k"),
        F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = scratch.table(rows, "rows").withColumn("cell", F.expr(f"k div {1 << (BITS - CELL_BITS)}"))
    # hot keys (fewer than HOT) cut their cells: what is before one, the key itself in SALTS parts, what is after it
    per_key = rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > F.greatest(F.lit(1000), F.lit(rows.count() // HOT)))
    hot = scratch.table(per_key.groupBy(F.expr(f"k div {1 << (BITS - CELL_BITS)}").alias("cell")).agg(F.collect_list("k").alias("hot")), "hot")
    rows = rows.join(F.broadcast(hot), "cell", "left")
    below, inside = F.size(F.filter("hot", lambda x: x < F.col("k"))), F.array_contains("hot", F.col("k"))
    part = F.when(F.col("hot").isNull(), 0).otherwise(2 * below + F.when(inside, 1).otherwise(0))
    rows = rows.withColumns({"part": part, "salt": F.when(F.coalesce(inside, F.lit(False)), F.col("salt")).otherwise(0)}).drop("hot")
    place = ["cell", "part", "salt"]
    cells = scratch.table(rows.groupBy("s", "none", *place).agg(F.sum("size").alias("cell_size")), "cells")
    sizes = cells.groupBy("s", "none").agg(F.sum("cell_size").alias("source_size"))
    budget = targets(sizes, tuple(weights), share, cap)
    budget = budget.withColumn("whole", F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.floor(F.lit(float(cap)) * F.col("source_size")).cast("bigint")))
    budget = budget.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0).cast("bigint")))
    budget = budget.withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    running = F.sum("cell_size").over(W.partitionBy("s", "none").orderBy(*place).rowsBetween(W.unboundedPreceding, -1))
    info = cells.select("s", "none", *place, F.coalesce(running, F.lit(0)).alias("offset")).join(budget, ["s", "none"])
    ahead = F.sum("size").over(W.partitionBy("s", "none", *place).orderBy("k", "key", "size").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(info, ["s", "none", *place])
    before = (F.col("offset") + F.col("ahead")).alias("before")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.withColumn("before", before).withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("bigint"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0, key="doc_id", source="source", text="text") -> DataFrame:
    """The mixed rows of ``docs``: each as often as the mix takes it, whole.

    The row at the cut is taken once more if that brings its source nearer to the target. Only
    each source's cut (its key) meets the texts, so texts are not shuffled; rows of one key go together.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = plan(docs, weights, share, cap, key, source, text, scratch)
    in_last = (F.col("rest") - F.col("before")) * 2 >= F.greatest(F.col("size"), F.lit(1))
    s, none, last, epochs, times = map(fresh, ("s", "none", "last", "epochs", "times"))
    ends = rows.groupBy("s", "none").agg(F.max(F.when(in_last, F.col("k"))).alias(last), F.first("epochs").alias(epochs))
    ends = scratch.table(ends.withColumnsRenamed({"s": s, "none": none}), "ends")
    same = (F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col(s)) & (F.col(source).isNull() == F.col(none))
    k = hash60(F.coalesce(F.col(key).cast("string"), F.lit("")))
    n = (F.col(epochs) + F.when(k <= F.col(last), 1).otherwise(0)).cast("int")
    taken = docs.join(ends, same).withColumn(times, n).filter(F.col(times) > 0)
    return taken.withColumn(last, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
