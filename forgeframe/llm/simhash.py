"""SimHash near-duplicates by the generalised pigeonhole principle (operator 7).

Fingerprints: the majority of XXH64 (seed 42) bits over a text's word shingles, repeats
included. A, words and white space are ASCII: ``bytes.lower().split()``. Texts of fewer words
than a shingle have one shingle, texts without words the fingerprint zero.

``links``: all pairs of distinct fingerprints at Hamming distance ``radius`` or less. Bits are
grouped into parts so that correlated bits stand together; part i gets its own threshold t_i
(-1: not probed) with sum(t_i + 1) = radius + 1, so two fingerprints within the radius differ
by at most t_i bits in some part. Dynamic programming chooses the thresholds of least cost,
from the number of pairs that agree on each part, counted over all fingerprints, and from all
bits' frequencies. Threshold 0 probes the part's value, threshold 1 its value without each
single bit. Buckets of up to ``BUCKET`` fingerprints are verified pair by pair. Larger ones
aren't: each of their fingerprints goes under itself and its 64 one-bit neighbours; those under
one neighbour are all within two bits of each other, at most 65 of them, and get star links.
This is exact for a radius of two and linear in the rows whatever the bucket's size.

``similar``: groups of texts of a given shingle similarity (such as 0.8 of five words), which
for 64 bits would be a radius of 14. ``links`` finds the nearest of them; a prefix filter on the
shingles finds the rest, as no radius that parts of 64 bits can be probed for reaches them.

Nulls: null texts count as empty, null keys never become a component's name unless all its
keys are null. Equal texts have equal fingerprints; repeated rows are all returned. Empty
tables give empty results. Very long texts are hashed whole, one at a time in a task. Extra
columns are not read, except by ``deduplicate``, which keeps them all; a key column named ``f`` or
``component`` gets an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from forgeframe.llm._common import Scratch, fresh, map_rows, tidied
from forgeframe.llm._graph import components

BUCKET = 64
ODD = 2048
#: Ids of up to so many texts (8 MB) are sent to all tasks instead of shuffling the texts to them.
SENT = 1_000_000


def shingle_hashes(texts: list[str | None], words: int):
    """XXH64 values of all shingles of all texts, and how many each text has."""
    import numpy as np
    import xxhash

    one, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        found = text.encode().lower().split() if text else []
        n = len(found)
        if n <= words:
            hashes += [one(b" ".join(found), 42)] if n else []
            counts.append(min(n, 1))
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[: n - words].tolist()]
        hashes += [one(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
        counts.append(n - words + 1)
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def majority(hashes, counts):
    """uint64 for each text: the bits set in over half of its hashes."""
    import numpy as np

    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.r_[0, np.cumsum(n)[:-1]]
    # sums of at most 255 bits fit a byte, so eight of them are added as one integer
    pieces = -(-n // 255)
    piece_of = np.repeat(np.arange(len(n)), pieces)
    inner = np.arange(len(piece_of)) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, first[piece_of] + 255 * inner, axis=0).view(np.uint8).astype(np.int64)
    sums = np.add.reduceat(sums, np.r_[0, np.cumsum(pieces)[:-1]], axis=0)
    out[full] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def key_name(key: str) -> str:
    """The key column's name in results: with an underscore if it is one of theirs."""
    return f"{key}_" if key in ("f", "component") else key


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, f): the 64-bit fingerprint as a signed integer."""
    import numpy as np

    def make():
        def block(columns):
            hashes, counts = shingle_hashes(columns[0], words)
            return [majority(hashes, counts).view(np.int64).tolist()]

        return block

    key_ = docs.select(key).schema[0]
    schema = StructType([StructField(key_name(key), key_.dataType), StructField("f", LongType())])
    return map_rows(docs.select(F.col(key).alias(key_name(key)), F.col(text).alias(fresh("text"))), schema, make, 1 << 20, 1)


def bit_counts(found: DataFrame):
    """64 x 64 array: how many fingerprints have both bits set; sums of a matrix for each partition."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)]
                total += (part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "n"])

    rows = found.mapInArrow(tidied(run), "i int, n array<bigint>")
    sums = rows.groupBy("i").agg(F.array(*[F.sum(F.col("n")[j]) for j in range(64)]).alias("n")).collect()
    out = np.zeros((64, 64), np.float64)
    for r in sums:
        out[r.i] = r.n
    return out


def grouped(both, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size: each starts with the lowest free bit and takes its most correlated ones."""
    import numpy as np

    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        mine = [min(free)]
        free -= set(mine)
        while len(mine) < size:
            best = max(sorted(free), key=lambda b: corr[b, mine].sum())
            mine.append(best)
            free.remove(best)
        out.append(sorted(mine))
    return out


def allocate(costs: list[dict[int, float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = radius + 1; costs[i][t] for t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in cost.items():
                if (at := used + t + 1) <= radius + 1 and (at not in step or c + more < step[at][0]):
                    step[at] = (c + more, [*ts, t])
        best = step
    return best.get(radius + 1, (math.inf, []))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(found: DataFrame, radius: int, choices=(2, 3)) -> list[int]:
    """The bit masks under which fingerprints are compared."""
    both = bit_counts(found)
    n = found.count()
    ways = {m: grouped(both, n, m) for m in choices}
    masks = [(m, i, signed(sum(1 << b for b in part))) for m, parts in ways.items() for i, part in enumerate(parts)]
    keyed = found.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("f").bitwiseAND(F.lit(mask)).alias("v")) for j, (_, _, mask) in enumerate(masks)])).alias("x")).select("x.*")
    pairs = {r.j: r.n for r in keyed.groupBy("j", "v").agg(F.count("*").cast("double").alias("n")).groupBy("j").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n")).collect()}
    p = both.diagonal() / max(n, 1)
    differ = [2 * x * (1 - x) for x in p]
    best = (math.inf, [])
    for m, parts in ways.items():
        costs = []
        for i, part in enumerate(parts):
            agree = pairs.get(next(j for j, (a, b, _) in enumerate(masks) if (a, b) == (m, i)), 0.0)
            # if one bit of the part may differ: the pairs that differ there, by that bit's frequency
            near = agree * (1 + sum(d / max(1 - d, 1e-9) for d in (differ[b] for b in part)))
            costs.append({-1: 0.0, 0: n + agree, 1: n * len(part) + near * 2})
        cost, ts = allocate(costs, radius)
        if cost < best[0]:
            chosen = []
            for part, t in zip(parts, ts):
                whole = sum(1 << b for b in part)
                chosen += [[], [whole], [whole & ~(1 << b) for b in part]][t + 1]
            best = (cost, [signed(x) for x in chosen])
    return best[1]


def links(found: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """(u, v): links that connect what all pairs within the radius connect. found: distinct (f)."""
    if radius != 2:
        raise ValueError("large buckets are exact for a radius of two only")
    masks = probes(found, radius)
    value = [F.struct(F.lit(i).alias("i"), F.col("f").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]
    keyed = scratch.table(found.select("f", F.explode(F.array(*value)).alias("x")).select("f", "x.i", "x.v"), "keyed")
    shared = scratch.table(keyed.groupBy("i", "v").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met = scratch.table(keyed.join(shared, ["i", "v"]), "met")
    small = met.filter(F.col("n") <= BUCKET).groupBy("i", "v").agg(F.collect_list("f").alias("a"))
    near = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: (y < x) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    verified = small.select(F.explode(near).alias("e")).select("e.u", "e.v").distinct()
    large = met.filter(F.col("n") > BUCKET).select("f").distinct()
    around = [F.col("f"), *[F.col("f").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)]]
    stars = large.select("f", F.explode(F.array(*around)).alias("k")).groupBy("k").agg(F.collect_set("f").alias("a")).filter(F.size("a") > 1)
    stars = stars.select(F.array_min("a").alias("v"), F.explode("a").alias("u")).filter("u <> v").select("u", "v").distinct()
    return verified.unionByName(stars)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, f, component): fingerprints within two bits are linked; a component is named by its smallest key."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, key, text, words), "fingerprints")
    key = key_name(key)
    found = scratch.table(rows.groupBy("f").agg(F.min(key).alias("least")), "distinct")
    roots = scratch.table(components(links(found.select("f"), scratch), scratch), "roots")
    named = found.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    named = scratch.table(named, "named")
    names = scratch.table(named.groupBy("root").agg(F.min("least").alias("component")), "names")
    by_f = scratch.table(named.join(names, "root").select("f", "component"), "by_f")
    for old in ("keyed", "met", "shared", "named", "names", "roots", "distinct"):
        scratch.drop(old)
    return rows.join(by_f, "f").select(key, "f", "component")


# ---- similarity of shingles ----------------------------------------------


def common(rows: DataFrame, scratch: Scratch, words: int, texts: int = 1 << 14, most: int = 1 << 18):
    """(hashes, ranks): shingles that several of a sample of texts have, sorted by hash; at most ``most``, the most frequent.

    They only order the shingles of a text. Any order gives the same groups; one that puts common
    shingles last gives few candidates.
    """
    import numpy as np
    import pyarrow as pa

    every = max(1, rows.count() // texts)
    sample = rows.filter(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(every)) == 0).select("t")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                hashes, counts = shingle_hashes(b.column("t").slice(at, 256).to_pylist(), words)
                sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    counted = scratch.table(sample.mapInArrow(tidied(run), "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2"), "common")
    least, total = 3, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r.n):
        total += r.m
        if total > most:
            least = r.n + 1
            break
    found = counted.filter(F.col("n") >= least).toArrow()
    scratch.drop("common")
    hashes, ranks = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def prefixes(rows: DataFrame, last, words: int, num: int, den: int) -> DataFrame:
    """(k, id, size, pos, odd, f): of each text's distinct shingles, in one order for all texts, as many of the
    first that two texts of similarity num / den share one of them. At position 0 only: odd, of each of ``ODD``
    classes of hashes whether the text has an odd number, and f, the text's fingerprint."""
    import numpy as np
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        common_hash, common_rank = sent.value
        for b in batches:
            step = max(1, b.num_rows if b.nbytes <= 1 << 20 else int(b.num_rows * (1 << 20) / b.nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                hashes, counts = shingle_hashes(part.column("t").to_pylist(), words)
                prints = majority(hashes, counts).view(np.int64).tolist()
                rank = np.zeros(len(hashes), np.int64)
                if len(common_hash):
                    i = np.minimum(np.searchsorted(common_hash, hashes), len(common_hash) - 1)
                    rank = np.where(common_hash[i] == hashes, common_rank[i], 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((hashes, rank, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]
                hashes, owner = hashes[new], owner[new]
                size = np.bincount(owner, minlength=len(counts))
                pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                odd = np.zeros((len(counts), ODD), np.uint8)
                np.bitwise_xor.at(odd, (owner, (hashes >> np.uint64(20)) % np.uint64(ODD)), 1)
                odd = np.packbits(odd, axis=1)
                take = pos <= size[owner] + -num * size[owner] // den
                own = owner[take]
                ids = part.column("h").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[take].view(np.int64)), pa.array(ids[own]), pa.array(size[own].astype(np.int32)), pa.array(pos[take].astype(np.int32)), *[pa.array([None if i else make(o) for i, o in zip(pos[take].tolist(), own.tolist())], kind) for make, kind in ((lambda o: odd[o].tobytes(), pa.binary()), (prints.__getitem__, pa.int64()))]], ["k", "id", "size", "pos", "odd", "f"])

    return rows.mapInArrow(tidied(run), "k bigint, id bigint, size int, pos int, odd binary, f bigint")


def shared(keys: DataFrame) -> DataFrame:
    """(k, id, size, pos) of the shingles k that several distinct texts have, each text once: one exchange, one sorted pass."""
    import numpy as np
    import pyarrow as pa

    names = ["k", "id", "size", "pos"]

    def run(batches):
        held, had = None, False  # the last row so far, and whether its shingle has one before it
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                now = [np.r_[x, y] for x, y in zip(held, now)]
            k, i = now[:2]
            new = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]
            now = [x[new] for x in now]
            same = now[0][1:] == now[0][:-1]
            several = np.r_[same, False] | np.r_[had, same]
            out = [x[:-1][several[:-1]] for x in now]
            held, had = [x[-1:] for x in now], bool(several[-1])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
        if had:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select(*names).repartition(parts, "k").sortWithinPartitions("k", "id").mapInArrow(tidied(run), "k bigint, id bigint, size int, pos int")


def possible(pairs: DataFrame, odd: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (u, v), those that odd (id, size, odd) doesn't rule out: each class in which one is odd
    and the other even has a shingle that only one of them has, so no similar pair is lost."""
    import numpy as np

    def make():
        def block(columns):
            if not columns[0]:
                return [[], [], []]
            a, b = (np.frombuffer(b"".join(c), np.uint64).reshape(len(c), -1) for c in columns[4:])
            both = np.array(columns[2], np.int64) + np.array(columns[3], np.int64)
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            # 2 * overlap = both - what differs
            return [*columns[:2], ((both - apart) * (num + den) >= 2 * num * both).tolist()]

        return block

    one = odd.select(F.col("id").alias("u"), F.col("size").alias("m"), F.col("odd").alias("a"))
    two = odd.select(F.col("id").alias("v"), F.col("size").alias("n"), F.col("odd").alias("b"))
    rows = pairs.join(one, "u").join(two, "v").select("u", "v", "m", "n", "a", "b")
    return map_rows(rows, "u bigint, v bigint, ok boolean", make).filter("ok").select("u", "v")


def can_reach(size, pos, size2, pos2, num: int, den: int, least):
    """Whether sets of these sizes whose first common element stands at these positions can be of similarity num / den."""
    return (least(size, size2) * (num + den) >= (size + size2) * num) & (least(size - pos, size2 - pos2) * (num + den) >= (size + size2) * num)


def forest(cells: DataFrame, num: int, den: int, more: int = 0) -> DataFrame:
    """(k, cell, u, v): of each bucket's cell, edges that join its roots as all its pairs do that may be similar.

    cells: (k, cell, half, id, size, pos, root, odd). A half of -1: every pair of the cell counts; otherwise those of
    its two halves. A half of -2: (id, root) is a pair known not to be similar. A pair may be similar if
    ``can_reach`` and the classes in which the two are odd allow it. There are fewer edges than members; with
    ``more``, up to so many times the members of the other possible pairs are given as well.
    """
    import numpy as np
    import pyarrow as pa

    def edges(half, ids, size, pos, root, odd):
        known = half == -2
        bad = set(zip(ids[known].tolist(), root[known].tolist())) if known.any() else ()
        half, ids, size, pos, root, odd = (x[~known] for x in (half, ids, size, pos, root, odd))
        order = np.argsort(ids)
        half, ids, size, pos, root, odd = (x[order] for x in (half, ids, size, pos, root, odd))
        label = np.unique(root, return_inverse=True)[1]
        first, left = (label.copy(), more * len(ids)) if more else (label, 0)
        place = np.arange(len(ids))
        for at in range(0, len(ids), 256):
            x = slice(at, at + 256)
            ok = can_reach(size[x, None], pos[x, None], size[None], pos[None], num, den, np.minimum)
            apart = first if left else label
            ok &= (apart[x, None] != apart[None]) & (place[x, None] < place[None]) & ((half[x, None] != half[None]) | (half[None] < 0))
            a, b = np.nonzero(ok)
            a += at
            for part in range(0, len(a), 4096):
                i, j = a[part : part + 4096], b[part : part + 4096]
                apart = first if left else label
                open_ = apart[i] != apart[j]
                i, j = i[open_], j[open_]
                both = size[i] + size[j]
                # 2 * overlap = both - what differs
                near = (both - np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64)) * (num + den) >= 2 * num * both
                i, j = i[near], j[near]
                while len(i):  # labels change with each edge, so what an edge joins is dropped
                    u, v = int(ids[j[0]]), int(ids[i[0]])
                    joins = label[i[0]] != label[j[0]]
                    if (u, v) in bad or not (joins or left):
                        i, j = i[1:], j[1:]
                        continue
                    yield u, v
                    if joins:
                        label[label == label[i[0]]] = label[j[0]]
                        i, j = (i[1:], j[1:]) if left else (x[1:][label[i[1:]] != label[j[1:]]] for x in (i, j))
                    else:
                        i, j, left = i[1:], j[1:], left - 1

    def flush(held):
        k, cell, *rest = (np.concatenate(x) for x in zip(*held))
        edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (cell[1:] != cell[:-1]), True])
        rows = [(int(k[a]), int(cell[a]), u, v) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()) for u, v in edges(*(c[a:z] for c in rest))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["k", "cell", "u", "v"])

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "cell", "half", "id", "size", "pos", "root")]
            none = bytes(ODD // 8)
            now.append(np.frombuffer(b"".join(x or none for x in b.column("odd").to_pylist()), np.uint64).reshape(b.num_rows, -1))
            # the last cell may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])])[-1])
            if held and last == 0 and (held[-1][0][-1], held[-1][1][-1]) == (now[0][0], now[1][0]):
                held.append(now)
                continue
            if last:
                held.append([x[:last] for x in now])
            if held:
                yield from flush(held)
            held = [[x[last:] for x in now]]
        if held:
            yield from flush(held)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "k", "cell").sortWithinPartitions("k", "cell").mapInArrow(tidied(run), "k bigint, cell bigint, u bigint, v bigint")


def verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch, words: int, num: int, den: int, name: str) -> DataFrame:
    """Pairs (u, v) of text ids whose shingle sets have a Jaccard similarity of num / den or more. rows: (h, t)."""
    import numpy as np
    import pyarrow as pa

    pairs = scratch.table(pairs, f"{name}-asked")
    asked = scratch.table(pairs.select(F.col("u").alias("h")).unionByName(pairs.select(F.col("v").alias("h"))).distinct(), f"{name}-ids")
    if asked.count() <= SENT:  # then texts need not be shuffled
        asked = F.broadcast(asked)

    def run(batches):
        seen: set = set()  # equal texts: once a task
        for b in batches:
            step = max(1, int(b.num_rows * (1 << 20) / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = part.column("h").to_pylist()
                new = [i for i, h in enumerate(ids) if not (h in seen or seen.add(h))]
                if not new:
                    continue
                part = part.take(pa.array(new))
                hashes, counts = shingle_hashes(part.column("t").to_pylist(), words)
                sets = [np.unique(x) for x in np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["h", "s"])

    sets = scratch.table(rows.join(asked, "h", "left_semi").select("h", "t").mapInArrow(tidied(run), "h bigint, s array<bigint>").dropDuplicates(["h"]), f"{name}-sets")
    one = sets.select(F.col("h").alias("u"), F.col("s").alias("a"))
    two = sets.select(F.col("h").alias("v"), F.col("s").alias("b"))
    common_ = F.size(F.array_intersect("a", "b"))
    alike = common_ * den >= num * (F.size("a") + F.size("b") - common_)
    found = scratch.table(pairs.join(one, "u").join(two, "v").filter(alike).select("u", "v"), f"{name}-verified")
    scratch.drop(f"{name}-sets")
    return found


def similar(rows: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, block: int = 4096) -> DataFrame:
    """(h, root): of each distinct text of rows (h its id, t), the root of its group, for texts that have one.

    Exact at any size: groups are the components of all pairs whose shingle sets have that Jaccard
    similarity, and every link is verified on whole shingle sets.

    First, pairs that ``links`` finds among the texts' fingerprints, and pairs of each text of a bucket with the
    bucket's smallest. Buckets come from a prefix filter: with the shingles of all texts in one order, two similar
    texts share one of the first n - ceil(similarity * n) + 1 of each, and what follows the first one shared must
    suffice for the similarity (``can_reach``). What is linked is contracted. Then, in buckets that still hold
    several groups, all pairs of different groups are compared where they lie and only a ``forest`` of edges
    leaves the bucket; where an edge turns out not to be similar, its cell is asked again without that pair, until
    none is left. Buckets over ``block`` texts are cut into blocks, and every block is compared with every other,
    in a cell of its own.
    """
    from fractions import Fraction

    num, den = Fraction(str(similarity)).as_integer_ratio()
    keys = scratch.table(prefixes(rows, common(rows, scratch, words), words, num, den), "keys")
    met = scratch.table(shared(keys), "buckets")
    marks = keys.filter("odd is not null").select("id", "size", "odd", "f").join(met.select("id").distinct(), "id", "left_semi")  # others are similar to none
    marks = scratch.table(marks.dropDuplicates(["id"]), "marks")
    scratch.drop("keys")

    prints = scratch.table(marks.groupBy("f").agg(F.min("id").alias("first")), "prints")
    name = lambda c: prints.select(F.col("f").alias(c), F.col("first").alias(f"{c}_first"))
    near = links(prints.select("f"), scratch).join(name("u"), "u").join(name("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    equal = marks.join(prints, "f").filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))

    first = met.groupBy("k").agg(F.min(F.struct("id", "size", "pos")).alias("x"))
    reach = can_reach(F.col("size"), F.col("pos"), F.col("x.size"), F.col("x.pos"), num, den, F.least)
    stars = met.join(first, "k").filter((F.col("id") != F.col("x.id")) & reach).select(F.col("id").alias("u"), F.col("x.id").alias("v"))
    asked = near.unionByName(equal).unionByName(stars).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    asked = scratch.table(asked, "asked")
    linked = verified(possible(asked, marks, num, den), rows, scratch, words, num, den, "first")
    groups = scratch.table(components(linked, scratch, "first"), "groups")

    root = lambda df: df.join(groups.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = root(met).groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).filter("a <> b and n > 2")
    several = several.select("k", F.ceil(F.col("n") / block).cast("bigint").alias("blocks"))
    open_ = met.join(several, "k").withColumn("block", F.pmod(F.xxhash64("id", "k"), "blocks"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cell = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    half = F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).cast("bigint")
    # a block's own cell has all its pairs; a cell of two blocks has the pairs between them
    cells = scratch.table(open_.select("k", cell.alias("cell"), half.alias("half"), "id", "size", "pos"), "cells")
    scratch.drop("buckets")
    bad = None
    turn = 0
    while True:
        turn += 1
        full = root(cells).join(marks.select("id", "odd"), "id").select("k", "cell", "half", "id", "size", "pos", "root", "odd")
        if bad is not None:
            pair = [F.lit(-2).cast("bigint").alias("half"), F.col("u").alias("id"), F.lit(0).alias("size"), F.lit(0).alias("pos"), F.col("v").alias("root"), F.lit(None).cast("binary").alias("odd")]
            full = full.unionByName(bad.select("k", "cell", *pair))
        found = scratch.table(forest(full, num, den, 16 if bad is not None else 0), f"forest{turn}")
        if found.isEmpty():
            break
        linked = linked.unionByName(verified(found.select("u", "v").distinct(), rows, scratch, words, num, den, f"turn{turn}"))
        groups = scratch.table(components(linked, scratch, f"turn{turn}"), f"groups{turn}")
        wrong = scratch.table(found.join(linked, ["u", "v"], "left_anti"), f"wrong{turn}")
        if wrong.isEmpty():
            break
        bad = wrong if bad is None else bad.unionByName(wrong)
        cells = scratch.table(cells.join(wrong.select("k", "cell").distinct(), ["k", "cell"], "left_semi"), f"cells{turn}")
    return groups.select(F.col("node").alias("h"), "root")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of equal or similar texts: the one with the smallest key.

    Null and empty texts are equal texts; texts without a word are similar to none. Whole texts are compared, however
    long. A text's id is a 64-bit hash, or another one for texts whose MD5 shows that they share it. Rows are chosen
    by (key, id): what is grouped and linked is narrow, and the texts meet the choice in one join. Rows that repeat
    key and text are one; null keys come last. An empty table gives an empty result; all columns are kept, whatever
    their names.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    t = F.coalesce(F.col(text), F.lit(""))
    seen = scratch.table(docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("h"), F.unhex(F.md5(t.cast("binary"))).alias("m")).groupBy("h", "m", "key").agg(F.count("*").alias("n")), "seen")
    # two of 2**32 texts share a hash by chance; at 10**11 texts some hundreds do
    clash = [r.h for r in seen.groupBy("h").agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a <> b").select("h").collect()]
    differ = lambda h, other: F.when(h.isin(clash), other).otherwise(h) if clash else h
    h = differ(F.xxhash64(t), F.xxhash64(F.unhex(F.md5(t.cast("binary"))), F.lit(1)))
    ids = seen.withColumn("h", differ(F.col("h"), F.xxhash64("m", F.lit(1))))
    # of texts that many documents have, one is compared: at most 10,000 such texts, so they are sent to all tasks
    counts = scratch.table(ids.groupBy("h").agg(F.sum("n").alias("n"), F.count("key").alias("named"), F.min("key").alias("key")), "counts")
    many = F.greatest(F.lit(100), F.ceil(counts.agg(F.sum("n")).scalar() / 10_000))
    often = scratch.table(counts.filter((F.col("n") > many) & (F.col("named") > 0)).select(F.col("h").alias("often"), F.col("key").alias("chosen")), "often")
    rows = docs.select(h.alias("h"), F.col(text).alias("t"), F.col(key).alias("key")).join(F.broadcast(often), F.col("h") == F.col("often"), "left")
    rows = rows.filter("often is null or key = chosen").select("h", "t")
    groups = similar(rows, scratch, words, similarity)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n")).alias("first")
    rooted = ids.groupBy("h").agg(first).join(groups, "h", "left").withColumn("root", F.coalesce("root", "h"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("first", "h")).alias("x"))
    mine, hash_, its, many = map(fresh, ("mine", "hash", "key", "many"))
    kept = scratch.table(kept.select(F.col("x.first.key").alias(its), F.col("x.h").alias(hash_), (F.col("x.first.n") > 1).alias(many)), "kept")
    out = docs.withColumn(mine, h).join(kept, (F.col(mine) == F.col(hash_)) & F.col(key).eqNullSafe(F.col(its)))
    again = out.filter(many).dropDuplicates([key, mine])  # rows that repeat key and text
    return out.filter(~F.col(many)).unionByName(again).select(*docs.columns)
