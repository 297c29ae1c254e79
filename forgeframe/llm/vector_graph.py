"""Embedding near-duplicates on a robust-pruned flat graph (operator 5).

Equal vectors become one node with a count. Centroids are fitted on a bounded sample; every
node goes to the shards of its ``overlap`` nearest centroids. Shards that are still larger than
``LARGE`` (crowds, or very many vectors) are split by random hyperplanes through their mean, a node
standing on both sides of the plane that it is nearest to, until none is larger. In each shard a
graph is built: a node's nearest candidates are pruned so that none is much nearer to a kept
neighbour than to the node (factor ``ALPHA``, at most ``DEGREE`` kept), and edges are added
backwards. The adjacency lists of a node from all its shards are united.

Every node is a query: a greedy beam search starts at the medoid of each of its shards (and at
the node itself), and from every node found at ``least`` cosine or more it goes on along edges
until it finds no other. Nodes found lie in other shards too, where their united lists go on: the
query is sent there, with the node found as its entry, and so on in rounds, each written to the
shared folder, until no query has a shard left to see. Cosines are double precision, so no link is
below ``least``.

A node that lies in several shards counts in one of them. A shard returns one row for each query
(its number of links, and the roots of what it found), never the pairs, and adds up block by block
of queries; components join the shards. Recall is audited in every run on up to ``AUDIT`` query
vectors against all vectors by brute force, in blocks, as the mean of the queries' shares; below
``recall`` the search is repeated with twice the overlap, and if four times doesn't do, all pairs
are compared in blocks. So no result leaves without a measured recall.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
nor do vectors of different lengths with each other. Vectors are scaled by their largest component
before they are normed, so that none over- or underflows. Repeated rows are all returned, linked by
their equal vectors; of equal vectors the smallest key names the component. Null ids name no
component unless alone. Extra columns aren't read. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeframe.llm._common import Scratch, tidied
from forgeframe.llm._graph import components

ALPHA, DEGREE, POOL, BEAM, AUDIT = 1.2, 24, 48, 32, 256
PER_SHARD, LARGE, SAMPLE, MOST_CENTROIDS = 1000, 4000, 20_000, 4096


# ---- one shard, in numpy ------------------------------------------------------------------


def unit(x):
    import numpy as np

    x = np.asarray(x, np.float64)
    if not len(x):
        return x
    most = np.abs(x).max(1, keepdims=True)
    # by a power of two, which loses no digit; ldexp twice, as one factor may not be a number
    up = -np.frexp(most)[1]
    x = np.ldexp(np.ldexp(x, up // 2), up - up // 2)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x, k: int, turns: int = 8):
    """k unit centroids of unit vectors x."""
    import numpy as np

    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        of = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, 1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def pruned(x):
    """Adjacency (n x up to 2 * DEGREE, -1 filled) of the robust-pruned graph over unit vectors x."""
    import numpy as np

    n = len(x)
    pool = min(POOL, n - 1)
    lists: list[list[int]] = [[] for _ in range(n)]
    if pool < 1:
        return np.full((n, 1), -1, np.int32)
    step = max(1, min(256, 8_000_000 // n))  # so that a block's cosines stay at 64 MB
    for a in range(0, n, step):
        s = x[a : a + step] @ x.T
        m = len(s)
        s[np.arange(m), np.arange(a, a + m)] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        inner = np.einsum("bid,bjd->bij", x[near], x[near])
        # distances of unit vectors: sqrt(2 - 2 cos)
        to_node, between = np.sqrt(np.maximum(0, 2 - 2 * sim)), np.sqrt(np.maximum(0, 2 - 2 * inner))
        alive, kept = np.ones((m, pool), bool), np.zeros((m, pool), bool)
        for j in range(pool):
            take = alive[:, j] & (kept.sum(1) < DEGREE)
            kept[:, j] = take
            alive &= ~(take[:, None] & (ALPHA * between[:, j] <= to_node))
        for i in range(m):
            lists[a + i] = near[i, kept[i]].tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(lists):
        for j in row:
            if len(back[j]) < DEGREE:
                back[j].append(i)
    for i in range(n):  # a ring over all nodes, so that every node can be reached
        back[i].append((i + 1) % n)
    return filled([sorted({*p, *q} - {i}) for i, (p, q) in enumerate(zip(lists, back))])


def filled(lists):
    import numpy as np

    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1, np.int32)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def merge(label, a, b):
    """Joins nodes a and b (arrays) in label, which names each node's smallest one."""
    import numpy as np

    pair = np.unique(np.stack([label[a], label[b]]), axis=1)
    a, b = pair[:, pair[0] != pair[1]]
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != label[label]).any():
            label[:] = label[label]


def search(q, x, adjacent, least: float, entry, found, nearest=None, block: int = 256):
    """Range-expanding search of queries q among nodes x. entry: a node for each query to begin at beside the medoid (-1:
    none). ``found(queries, nodes)`` gets each pair at cosine ``least`` or more once, block by block of queries;
    ``nearest(queries, nodes)`` the best of each beam."""
    import numpy as np

    n = len(x)
    block = max(1, min(block, 32_000_000 // n))
    medoid, edge = int(np.argmax(x @ x.mean(0))), None
    for first in range(0, len(q), block):
        y = q[first : first + block]
        m = len(y)
        seen = np.zeros((m, n), bool)
        ids, sims, done = np.full((m, BEAM), -1, np.int64), np.full((m, BEAM), -2.0), np.ones((m, BEAM), bool)
        start = np.stack([np.full(m, medoid), entry[first : first + block]], 1)
        hits = []
        for col in (0, 1):
            row = np.flatnonzero((start[:, col] >= 0) & ((start[:, 1] != medoid) if col else True))
            node = start[row, col]
            ids[row, col], sims[row, col], done[row, col] = node, np.einsum("ij,ij->i", y[row], x[node]), False
            seen[row, node] = True
            hit = sims[row, col] >= least
            hits.append((row[hit], node[hit]))
        live = np.arange(m)
        while len(live):
            open_sims = np.where(done[live], -3.0, sims[live])
            best = np.argmax(open_sims, 1)
            go = open_sims[np.arange(len(live)), best] > -2.5
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = adjacent[ids[live, best]]
            new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(new)
            node = near[row, col]
            seen[live[row], node] = True
            s = np.full(near.shape, -2.0)
            s[row, col] = np.einsum("ij,ij->i", y[live[row]], x[node])
            hit = s[row, col] >= least
            hits.append((live[row[hit]], node[hit]))
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_done = np.concatenate([done[live], s < -1.5], 1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            ids[live], sims[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_done))
        if nearest is not None:
            best = np.argpartition(-sims, 2, axis=1)[:, :2]
            row, col = np.nonzero(np.take_along_axis(sims, best, 1) > -1.5)
            nearest(row + first, ids[row, best[row, col]])
        # from what was found, along edges, as far as the range goes
        fq, fx = (np.concatenate(z) for z in zip(*hits))
        while len(fq):
            found(fq + first, fx)
            if len(fq) > 64 * m:  # a crowd: all edges at once
                if edge is None:
                    edge = np.zeros((n, n), np.float32)
                    edge[np.repeat(np.arange(n), adjacent.shape[1])[(adjacent >= 0).ravel()], adjacent[adjacent >= 0]] = 1
                at = np.zeros((m, n), np.float32)
                at[fq, fx] = 1
                ahead = at @ edge > 0
            else:
                ahead = np.zeros((m, n), bool)
                for col in range(adjacent.shape[1]):
                    node = adjacent[fx, col]
                    ok = node >= 0
                    ahead[fq[ok], node[ok]] = True
            ahead &= ~seen
            seen |= ahead
            row, node = np.nonzero(ahead)
            keep = np.concatenate([np.einsum("ij,ij->i", y[row[b : b + 65536]], x[node[b : b + 65536]]) for b in range(0, len(row), 65536)] or [np.zeros(0)]) >= least
            fq, fx = row[keep], node[keep]


# ---- all shards ---------------------------------------------------------------------------


def grouped(rows: DataFrame, run, schema: str) -> DataFrame:
    """One call of ``run(pandas frame)`` for each shard."""
    return rows.groupBy("shard").applyInPandas(run, schema)


def assigned(nodes: DataFrame, scratch: Scratch, overlap: int) -> DataFrame:
    """(shard, h): each node's shards. nodes: (h, v)."""
    import numpy as np
    import pyarrow as pa

    spark, total = nodes.sparkSession, nodes.count()
    k = min(MOST_CENTROIDS, max(1, math.ceil(total / PER_SHARD)))
    share = min(1.0, SAMPLE / max(total, 1))
    sample = nodes.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("h", "v").collect() if k > 1 else []  # about SAMPLE rows
    sample = unit([r.v for r in sorted(sample, key=lambda r: r.h)]) if sample else np.zeros((0, 1))
    centroids = spark.sparkContext.broadcast(fit(sample, k) if len(sample) else None)  # at most MOST_CENTROIDS

    def nearest(batches):
        c = centroids.value
        for b in batches:
            if not b.num_rows:
                continue
            near = np.zeros((b.num_rows, 1), np.int64) if c is None else np.concatenate([np.argsort(-(unit(b.column("v").slice(a, 1024).to_pylist()) @ c.T), axis=1, kind="stable")[:, :overlap] for a in range(0, b.num_rows, 1024)])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column("h").take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))], ["shard", "h"])

    rows = scratch.table(nodes.select("h", "v").mapInArrow(tidied(nearest), "shard bigint, h bigint"), f"shards{overlap}")
    for level in range(20):
        large = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).collect()}  # fewer than a row in LARGE
        if not large:
            break
        names = spark.createDataFrame([(s,) for s in large], "shard bigint")
        inside = scratch.table(rows.join(F.broadcast(names), "shard", "left_semi").join(nodes.select("h", "v"), "h"), f"large{overlap}-{level}")

        def sums(batches):
            held: dict = {}
            for b in batches:
                x, of = unit(b.column("v").to_pylist()), b.column("shard").to_numpy(zero_copy_only=False)
                for s in np.unique(of).tolist():
                    held[s] = held.get(s, 0) + x[of == s].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["shard", "v"])

        means: dict = {}
        for r in inside.select("shard", "v").mapInArrow(tidied(sums), "shard bigint, v array<double>").groupBy("shard").agg(F.collect_list("v").alias("v")).collect():  # a row for each large shard, a vector for each task
            means[r.shard] = np.sum(r.v, 0) / large[r.shard]
        sent = spark.sparkContext.broadcast((large, means))

        def split(batches, level=level):
            large, means = sent.value
            for b in batches:
                x, of = unit(b.column("v").to_pylist()), b.column("shard").to_numpy(zero_copy_only=False)
                out_s, out_h = [], []
                for s in np.unique(of).tolist():
                    mine = np.flatnonzero(of == s)
                    bits = max(1, math.ceil(math.log2(large[s] / PER_SHARD)))
                    planes = np.random.default_rng([level, s & 0xFFFFFFFF]).normal(size=(x.shape[1], bits))
                    side = (x[mine] - means[s]) @ planes
                    code = ((side > 0) << np.arange(bits)).sum(1)
                    other = code ^ (1 << np.argmin(np.abs(side), 1))  # across the nearest plane
                    both = np.concatenate([code, other]).astype(np.uint64) + np.uint64(1)
                    mixed = (np.uint64(s & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + both * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
                    out_s.append(mixed.astype(np.int64))
                    out_h.append(np.tile(mine, 2))
                if out_s:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_s)), b.column("h").take(pa.array(np.concatenate(out_h)))], ["shard", "h"])

        kept = rows.join(F.broadcast(names), "shard", "left_anti")
        rows = scratch.table(kept.unionByName(inside.select("shard", "h", "v").mapInArrow(tidied(split), "shard bigint, h bigint")).distinct(), f"split{overlap}-{level}")
        scratch.drop(f"large{overlap}-{level}")
    return rows


def link(nodes: DataFrame, least: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(h, links) of nodes (h, n, v), several rows a node: how many rows' vectors it links with; and edges (u, v)."""
    import numpy as np
    import pandas as pd

    scratch = Scratch(nodes.sparkSession, "links")
    shards = assigned(nodes, scratch, overlap)
    of = shards.groupBy("h").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # few a node
    members = scratch.table(shards.join(nodes.select("h", "n", "v").join(of, "h"), "h").select("shard", "h", "n", "v", "shards"), f"members{overlap}")

    def build(pdf):
        pdf = pdf.sort_values("h")
        h = pdf["h"].to_numpy()
        adjacent = pruned(unit(np.stack(pdf["v"].to_list())))
        return pd.DataFrame({"h": h, "near": [h[row[row >= 0]] for row in adjacent]})

    lists = grouped(members.select("shard", "h", "v"), build, "h bigint, near array<bigint>")
    united = scratch.table(lists.groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"lists{overlap}")  # a list for each shard

    class Shard:
        """A shard's nodes, their united lists as far as they stay in it, and what searches in it have found."""

        def __init__(self, pdf, queries: int):
            pdf = pdf.sort_values("h")
            self.h, self.n, self.x = pdf["h"].to_numpy(), pdf["n"].to_numpy(), unit(np.stack(pdf["v"].to_list()))
            lists = []
            for near in pdf["near"]:
                near = np.asarray(near)
                at = np.minimum(np.searchsorted(self.h, near), len(self.h) - 1)
                lists.append(at[self.h[at] == near].tolist())
            self.adjacent = filled(lists)
            self.mine = int(pdf["shard"].iloc[0])
            self.known, code = np.unique(np.concatenate(pdf["shards"].to_list()), return_inverse=True)
            size = pdf["shards"].map(len).to_numpy()
            self.shards = np.full((len(pdf), int(size.max())), -1, np.int64)  # each node's, as places in known
            self.shards[np.repeat(np.arange(len(pdf)), size), np.concatenate([np.arange(k) for k in size])] = code
            self.links = np.zeros(queries, np.int64)
            self.entry = np.full((queries, len(self.known)), -1, np.int32)  # of each query and shard, a node that leads there

        def among(self, lists) -> object:
            """Of lists of shards, which of known each holds."""
            out = np.zeros((len(lists), len(self.known) + 1), bool)
            for row, x in zip(out, lists):
                at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
                row[at[self.known[at] == np.asarray(x)]] = True
            out[:, -1] = False
            return out

        def count(self, q, x, now, before) -> None:
            """Pairs count in the first shard of this round's that holds the node, unless one of an earlier round's does."""
            ok = np.ones(len(q), bool)
            place = int(np.searchsorted(self.known, self.mine))
            for col in range(self.shards.shape[1]):
                s = self.shards[x, col]  # -1 is the last column, which is false
                ok &= ~before[q, s] & ~(now[q, s] & (s < place))
            np.add.at(self.links, q[ok], self.n[x[ok]])

        def lead(self, q, x) -> None:
            for col in range(self.shards.shape[1]):
                s = self.shards[x, col]
                ok = s >= 0
                self.entry[q[ok], s[ok]] = x[ok]

        def onward(self, seen) -> tuple[list, list]:
            """Of each query, the shards that it has not seen yet, and a node of each."""
            open_ = (self.entry >= 0) & ~seen[:, :-1]
            at = [np.flatnonzero(row) for row in open_]
            return [self.known[a] for a in at], [self.h[self.entry[i, a]] for i, a in enumerate(at)]

    def home(pdf):
        shard = Shard(pdf, len(pdf))
        pdf = pdf.sort_values("h")
        label = np.arange(len(pdf))
        now = shard.among(pdf["shards"].to_list())
        never = np.zeros_like(now)

        def found(q, x):
            other = q != x
            q, x = q[other], x[other]
            shard.count(q, x, now, never)
            shard.lead(q, x)
            merge(label, q, x)

        search(shard.x, shard.x, shard.adjacent, least, np.arange(len(pdf)), found, shard.lead)
        to, entry = shard.onward(now)
        return pd.DataFrame({"shard": shard.mine, "h": shard.h, "links": shard.links, "root": shard.h[label], "to": to, "entry": entry})

    full = members.join(united, "h")
    done = scratch.table(grouped(full, home, "shard bigint, h bigint, links bigint, root bigint, to array<bigint>, entry array<bigint>"), f"found{overlap}-0")
    links = done.select("h", "links")
    edges = done.filter("h <> root").select(F.col("h").alias("u"), F.col("root").alias("v"))
    roots = done.select("shard", "h", "root")
    visits = shards.select("h", "shard")
    turn = 0

    def guest(key, guests, pdf):
        if not len(guests) or not len(pdf):
            return pd.DataFrame({"h": [], "links": [], "roots": [], "to": [], "entry": []})
        shard = Shard(pdf, len(guests))
        root = pdf.sort_values("h")["root"].to_numpy()
        now, before = shard.among(guests["now"].to_list()), shard.among(guests["before"].to_list())
        linked: list[set] = [set() for _ in range(len(guests))]

        def found(q, x):
            shard.count(q, x, now, before)
            shard.lead(q, x)
            for i, r in zip(*np.unique(np.stack([q, root[x]]), axis=1).tolist()):
                linked[i].add(r)

        at = np.minimum(np.searchsorted(shard.h, guests["entry"].to_numpy()), len(shard.h) - 1)
        search(unit(np.stack(guests["v"].to_list())), shard.x, shard.adjacent, least, np.where(shard.h[at] == guests["entry"].to_numpy(), at, -1), found)
        to, entry = shard.onward(now | before)
        return pd.DataFrame({"h": guests["h"].to_numpy(), "links": shard.links, "roots": [sorted(r) for r in linked], "to": to, "entry": entry})

    while True:
        ways = done.filter("size(to) > 0").select("h", F.explode(F.arrays_zip("to", "entry")).alias("w")).groupBy("h", F.col("w.to").alias("shard")).agg(F.min("w.entry").alias("entry"))
        ways = scratch.table(ways.join(visits, ["h", "shard"], "left_anti"), f"ways{overlap}-{turn}")
        if ways.isEmpty():
            break
        turn += 1
        asked = ways.groupBy("h").agg(F.collect_set("shard").alias("now")).join(visits.groupBy("h").agg(F.collect_set("shard").alias("before")), "h")
        guests = ways.join(asked.join(nodes.select("h", "v"), "h"), "h").select("shard", "h", "v", "entry", "now", "before")
        inside = full.join(ways.select("shard").distinct(), "shard", "left_semi").join(roots, ["shard", "h"])
        met = guests.groupBy("shard").cogroup(inside.groupBy("shard")).applyInPandas(guest, "h bigint, links bigint, roots array<bigint>, to array<bigint>, entry array<bigint>")
        done = scratch.table(met, f"found{overlap}-{turn}")
        links = links.unionByName(done.select("h", "links"))
        edges = edges.unionByName(done.select(F.col("h").alias("u"), F.explode("roots").alias("v")))
        visits = visits.unionByName(ways.select("h", "shard"))
    return links, edges


def every_pair(nodes: DataFrame, least: float, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """As ``link``, from all pairs: blocks of nodes against blocks of nodes, a cell each."""
    import numpy as np
    import pandas as pd

    blocks = max(1, math.ceil(nodes.count() / block))
    rows = nodes.withColumn("b", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(blocks)))
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")).withColumn("cell", F.col("b") * blocks + F.col("c"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")).withColumn("cell", F.col("c") * blocks + F.col("b"))

    def run(key, one, two):
        if not len(one) or not len(two):
            return pd.DataFrame({"h": [], "links": [], "roots": []})
        x, y = unit(np.stack(one["v"].to_list())), unit(np.stack(two["v"].to_list()))
        mine, other, n = one["h"].to_numpy(), two["h"].to_numpy(), two["n"].to_numpy()
        label, links, first = np.arange(len(x) + len(y)), [], []
        for at in range(0, len(x), 512):
            near = (x[at : at + 512] @ y.T >= least) & (mine[at : at + 512, None] != other[None])
            links.append(near @ n)
            a, b = np.nonzero(near)
            merge(label, a + at, b + len(x))
        # stars: every node of the cell to one of its group there
        ids = np.concatenate([mine, other])
        ends = [[ids[label[i]]] if label[i] != i else [] for i in range(len(x))]
        more = [(ids[i], ids[label[i]]) for i in range(len(x), len(ids)) if label[i] != i]
        out = pd.DataFrame({"h": mine, "links": np.concatenate(links).astype(np.int64), "roots": ends})
        return pd.concat([out, pd.DataFrame({"h": [u for u, _ in more], "links": 0, "roots": [[v] for _, v in more]})]) if more else out

    keep = ["cell", "h", "n", "v"]
    met = left.select(*keep).groupBy("cell").cogroup(right.select(*keep).groupBy("cell")).applyInPandas(run, "h bigint, links bigint, roots array<bigint>")
    met = Scratch(nodes.sparkSession, "links").table(met, "every")
    return met.select("h", "links"), met.select(F.col("h").alias("u"), F.explode("roots").alias("v"))


def audit(nodes: DataFrame, links: DataFrame, least: float) -> float:
    """Of up to ``AUDIT`` nodes the mean share of links, found by brute force over all nodes in blocks, that ``links`` (h, links) has."""
    import numpy as np

    queries = nodes.orderBy(F.xxhash64("h", F.lit(1)), "h").limit(AUDIT).select("h", "v").collect()
    if not queries:
        return 1.0
    q = unit([r.v for r in queries])
    ids = np.array([r.h for r in queries])

    def brute(batches):
        import pyarrow as pa

        total = np.zeros(len(ids), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if part.num_rows:
                    near = (q @ unit(part.column("v").to_pylist()).T >= least) & (ids[:, None] != part.column("h").to_numpy()[None, :])
                    total += (near * part.column("n").to_numpy()[None, :]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["h", "true_links"])

    true = nodes.select("h", "n", "v").mapInArrow(tidied(brute), "h bigint, true_links bigint").groupBy("h").agg(F.sum("true_links").alias("true_links"))
    share = F.least("true_links", F.coalesce("links", F.lit(0))) / F.col("true_links")
    row = true.join(links, "h", "left").filter("true_links > 0").agg(F.avg(share).alias("a")).first()
    return 1.0 if row.a is None else row.a


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, overlap: int = 2, recall: float = 0.95) -> DataFrame:
    """key, n_links, component (its smallest key), kept (it is that one) of every row."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.when(F.coalesce(sound, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes = scratch.table(rows.filter("h is not null").groupBy("h", "v").agg(F.count("*").alias("n"), F.min("key").alias("least")), "nodes")
    # two of 2**32 vectors share a hash by chance: those get another one
    clash = [r.h for r in nodes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h").collect()]
    if clash:
        other = F.when(F.col("h").isin(clash), F.xxhash64("v", F.lit(1))).otherwise(F.col("h"))
        rows, nodes = rows.withColumn("h", other), scratch.table(nodes.withColumn("h", other), "apart")
    lengths = [r.d for r in nodes.groupBy(F.size("v").alias("d")).count().filter("count > 1").select("d").collect()]
    per_node = edges = None
    for d in sorted(lengths):
        mine = nodes.filter(F.size("v") == d)
        for width in (overlap, 2 * overlap, 4 * overlap, 0):
            links, ends = link(mine, least, width) if width else every_pair(mine, least)
            counts = scratch.table(links.groupBy("h").agg(F.sum("links").alias("links")), f"counts{d}-{width}")
            if not width or audit(mine, counts, least) >= recall:
                break
        per_node = counts if per_node is None else per_node.unionByName(counts)
        edges = ends if edges is None else edges.unionByName(ends)
    if per_node is None:
        per_node = nodes.select("h", F.lit(0).cast("bigint").alias("links")).limit(0)
        edges = nodes.select(F.col("h").alias("u"), F.col("h").alias("v")).limit(0)
    joined = components(edges, scratch)
    counts = per_node
    named = nodes.select("h", "n", "least").join(counts, "h", "left").join(joined.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = scratch.table(named, "named")
    names = scratch.table(named.groupBy("root").agg(F.min("least").alias("component")), "names")
    by_node = scratch.table(named.join(names, "root").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "by_node")
    out = rows.select("key", "h").join(by_node, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component"), F.col("key").eqNullSafe(component).alias("kept"))
