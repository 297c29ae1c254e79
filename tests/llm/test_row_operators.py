"""URL filter, shards, mixes, SimHash, vectors and the pipeline against brute force, with odd inputs."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.llm import mixing, sharding, simhash, url_filter, vector_graph
from forgeframe.llm._common import Scratch
from forgeframe.llm._graph import components
from forgeframe.llm.queries import RULES


def groups(n, pairs):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


# ---- URLs ---------------------------------------------------------------------------------


def naive_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def naive_rule(host, path):
    fits = [(len(t), t, v) for v, t in RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "x", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net", "http://net/", "http://internet/", "ftp://u:p@É.net:80/a/b", "http://example.com/de", "http://example.com/de/x", "http://a.example.com/de/", "http://example.com?de/", "http://org/fr/1", "http://x.org/fr#", "http://x.org/FR/", "a://b://c/d", "http://example.net/en/", "http://h\n/p\nq", "http://x.io/" + "a" * 3000] * 2


def test_rules(spark):
    many = URLS + [f"http://s{i}.example.net/en/{i}" for i in range(80)] + [f"http://casino{i}.net/win/{i}" for i in range(80)] + [f"http://m.example.com/en/{i}" for i in range(40)] + [f"http://casino{i}.example.com/win/{i}" for i in range(40)]
    rows = url_filter.judge(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(many)], "page_id bigint, url string, host string"), RULES).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(many)))
    by_url = defaultdict(set)
    for r in rows:
        host, path = naive_parts(many[r.page_id])
        name, says = naive_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), r
        assert r.verdict == says if name else r.verdict in ("allow", "block")
        by_url[r.url].add((r.verdict, r.score))
    assert all(len(v) == 1 for v in by_url.values()) and by_url[None] == {("block", None)}
    judged = {r.url: r.verdict for r in rows if r.rule is None and r.url}
    assert sum(judged[f"http://m.example.com/en/{i}"] == "allow" for i in range(40)) >= 36
    assert sum(judged[f"http://casino{i}.example.com/win/{i}"] == "block" for i in range(40)) >= 36


def test_url_scores_equal_a_plain_model(spark):
    order, accepted, rejected = 3, ["http://ab/", "http://aab/c", "http://abc/"], ["http://zz/", "http://zza/", "http://za/z"]
    data = [(u, True) for u in accepted] + [(u, False) for u in rejected]
    scratch = Scratch(spark, "t")
    model = url_filter.train(spark.createDataFrame(data, "url string, accepted boolean"), order, 1e-9, scratch)
    asked = ["http://ab/zz", "q", ""]
    got = {r.url: r.score for r in url_filter.score(spark.createDataFrame([(u,) for u in asked], "url string"), model, order).collect()}
    mark = lambda u: "\x02" + u + "\x03"
    grams = {True: Counter(), False: Counter()}
    for u, a in data:
        t = mark(u)
        grams[a].update(t[i : i + n] for n in range(1, order + 1) for i in range(len(t) - n + 1))
    both = grams[True] + grams[False]
    kept = {s for s, n in both.items() if len(s) == 1 or n >= 2}
    size = sum(n for s, n in both.items() if len(s) == 1)
    letters = sum(len(s) == 1 for s in both)

    def p(a, context, x):
        g = grams[a]
        if not context:
            return (g[x] + 1) / (sum(n for s, n in g.items() if len(s) == 1) + letters + 1)
        low = p(a, context[1:], x)
        after = [s for s in both if len(s) == len(context) + 1 and s.startswith(context)]
        used = [s for s in after if s in kept]
        if not used:
            return low
        whole = sum(g[s] for s in after) + sum(g[s] > 0 for s in after)
        if not whole:
            return low
        return (g[context + x] / whole if context + x in kept else 0) + (whole - sum(g[s] for s in used)) / whole * low

    assert size > 0
    for u in asked:
        t, total = mark(u), 0.0
        for i, x in enumerate(t):
            if x in kept:
                context = t[max(0, i - order + 1) : i]
                while context and (context not in kept or len(context) > i):
                    context = context[1:]
                total += math.log(p(True, context, x)) - math.log(p(False, context, x))
        assert got[u] == pytest.approx(total / (len(u) + 1), abs=1e-6), u


def test_long_and_common_urls(spark):
    """A URL of several pieces scores as one, and one that most rows have is judged like others."""
    long = "http://m.example.com/" + "".join(random.Random(1).choices("abcdefgh/-", k=5000))
    labelled = [f"http://s{i}.example.net/en/{i}" for i in range(80)] + [f"http://casino{i}.net/win/{i}" for i in range(80)]
    urls = labelled + [long, "http://common.example.com/x"] + ["http://common.example.com/x"] * 1500
    rows = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string"), RULES).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    assert len({(r.verdict, r.score) for r in rows if r.url == urls[161]}) == 1 and all(r.score is not None for r in rows if r.rule is None)
    text = "\x02" + long + "\x03"
    found = Counter(r.s for r in url_filter.substrings(spark.createDataFrame([(long,)], "url string"), 4).collect())
    assert found == Counter(text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1))


def test_url_edges(spark):
    schema = "page_id bigint, url string"
    assert url_filter.judge(spark.createDataFrame([], schema), RULES).count() == 0
    rows = url_filter.judge(spark.createDataFrame([(1, "http://a.io/"), (2, None)], schema), RULES).collect()
    assert {(r.page_id, r.verdict) for r in rows} == {(1, "allow"), (2, "block")}


# ---- shards -------------------------------------------------------------------------------


def fewest(sizes, capacity):
    n, left = 1, capacity
    for s in sizes:
        if s > capacity:
            return math.inf
        if s > left:
            n, left = n + 1, capacity
        left -= s
    return n


@pytest.mark.parametrize("seed, n, shards", [(0, 300, 8), (1, 5, 8), (2, 40, 3), (3, 400, 5)])
def test_shards_are_minimax(spark, seed, n, shards):
    draw = random.Random(seed)
    texts = [draw.choice(["", "dup", None, "x" * draw.randrange(400), f"t{draw.randrange(30)}" * draw.randrange(1, 30)]) for _ in range(n)] + ["big" * 200] * 9
    docs = spark.createDataFrame([(None if i % 11 == 0 else i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, shard int")
    rows = sharding.shard(docs, shards).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    at, load, crc = defaultdict(set), Counter(), Counter()
    for r in rows:
        at[r.text_crc32, r["size"]].add(r.shard)
        load[r.shard] += r["size"]
        crc[r.text_crc32] += 1
    assert all(len(s) == 1 for s in at.values()) and set(by) <= set(range(shards))
    assert crc == Counter(None if t is None else zlib.crc32(t.encode()) for t in texts)
    atoms = Counter()
    for t in texts:
        atoms[t] += len((t or "").encode()) + 1
    keyed = sorted((sharding_hash(t), s) for t, s in atoms.items())
    sizes = [sum(s for _, s in g) for _, g in itertools.groupby(keyed, key=lambda x: x[0])]
    best = next(c for c in itertools.count(max(max(sizes), -(-sum(sizes) // shards))) if fewest(sizes, c) <= shards)
    assert max(load.values()) <= best and fewest(sizes, best - 1) > shards


def sharding_hash(t):
    import hashlib

    return 0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)


def test_shard_edges(spark):
    schema = "doc_id bigint, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    rows = sharding.shard(spark.createDataFrame([(1, None)] * 5, schema)).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2, 3, 4] and {r.text_crc32 for r in rows} == {None} and len({r.shard for r in rows}) == 1


# ---- mixes --------------------------------------------------------------------------------


def naive_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [k for k in names if k not in fixed]
        left, all_w = total - sum(fixed.values()), sum(w[k] for k in free)
        out = {k: left * w[k] / all_w for k in free}
        over = [k for k in free if out[k] > cap * sizes[k]]
        if not over:
            return fixed | out
        fixed |= {k: cap * sizes[k] for k in over}


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i if i % 17 else None, draw.choice(["b", "a", "é", None, "hot", "hot", "hot"]), draw.choice([None, "", " ".join(["w"] * draw.randrange(60))]), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int")
    got = mixing.plan(docs).collect()
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    want = naive_targets(dict(sizes))
    taken, seen = Counter(), {}
    for r in got:
        s = None if r.none else r.s
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        seen[s] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in seen.items())
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, got))
    out = mixing.mix(docs).collect()
    words = Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    assert all(abs(words[s] - t) <= 60 * 40 for s, t in seen.items()) and max(Counter((r.doc_id, r.source, r.text) for r in out if r.doc_id is not None).values()) <= 2
    assert set(out) <= set(docs.collect())


def test_mix_edges(spark):
    schema = "doc_id bigint, source string, text string"
    assert mixing.plan(spark.createDataFrame([], schema)).count() == 0 and mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert {r.taken for r in mixing.plan(spark.createDataFrame([(1, "a", None), (1, "a", "")], schema)).collect()} == {0}
    one = mixing.plan(spark.createDataFrame([(1, "a", "x y"), (2, "a", "z")], schema)).collect()
    assert sum(r.taken for r in one) in (4, 5) and {r.target for r in one} == {4.5}


def test_mix_with_a_hot_key(spark):
    """Null keys and one repeated key make up most rows: they lie in several cells, sums stay exact, reruns agree."""
    draw = random.Random(5)
    rows = [(None if i % 3 else 7, "ab"[i % 5 == 0], " ".join(["w"] * draw.randrange(40)) + f" {i}") for i in range(6000)] + [(i, "a", "x y") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    scratch = Scratch(spark, "t")
    got = mixing.plan(docs, scratch=scratch).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for _, s, t in rows:
        sizes[s] += len(t.split())
    for r in got:
        taken[r.s] += r.taken
        targets[r.s] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.s]
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in targets)
    assert len({(r.cell, r.part, r.salt) for r in got if r.key is None}) > 100
    some = [sorted(((str(r.key), r["size"], r.taken) for r in x)) for x in (got, mixing.plan(docs.repartition(3)).collect())]
    assert some[0] == some[1]


# ---- SimHash ------------------------------------------------------------------------------


def naive_fingerprint(text, k=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    draw = random.Random(6)
    texts = [None, "", " \t", "one", "Two WORDS", "three little words", "a b c d", "É É é é", *[" ".join(draw.choices("abcdefg", k=n)) for n in (5, 40, 700)], "same same"] * 2
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id bigint, text string, f int")
    got = {r.doc_id: r for r in simhash.classes(docs).collect()}
    prints = [naive_fingerprint(t) for t in texts]
    label = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for i, f in enumerate(prints):
        assert got[i].f % 2**64 == f and got[i].component == label[i]
    for clash in ("f", "component"):
        other = simhash.classes(docs.drop("f").withColumnRenamed("doc_id", clash), clash)
        assert other.columns == [clash + "_", "f", "component"] and {r[0]: (r.f, r.component) for r in other.collect()} == {k: (r.f, r.component) for k, r in got.items()}


@pytest.mark.parametrize("crowd", [0, 300])
def test_links_connect_all_near_pairs(spark, crowd):
    draw = random.Random(crowd)
    seeds = [draw.getrandbits(64) for _ in range(60)]
    near = [s ^ (1 << draw.randrange(64)) ^ (draw.random() < 0.6) * (1 << draw.randrange(64)) ^ (draw.random() < 0.3) * (1 << draw.randrange(64)) for s in seeds for _ in range(3)]
    near += [seeds[0] ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(40)) for _ in range(crowd)]
    prints = sorted(set(seeds + near + [0, 1, 2**63]))
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "f bigint")
    scratch = Scratch(spark, "t")
    pairs = simhash.links(df, scratch).collect()
    at = {simhash.signed(x): i for i, x in enumerate(prints)}
    assert all((p.u ^ p.v).bit_count() <= 2 or ((p.u ^ p.v) % 2**64).bit_count() <= 2 for p in pairs)
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert groups(len(prints), [(at[p.u], at[p.v]) for p in pairs]) == want


def test_thresholds():
    cost, ts = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 100, 1: 900}, {-1: 0, 0: 7, 1: 8}], 2)
    assert (cost, ts) == (13, [0, -1, 1])


def test_deduplicate(spark):
    draw = random.Random(8)
    base = [" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        words = t.split()
        for k in range(3):
            copy = list(words)
            for _ in range(2):
                copy[draw.randrange(300)] = f"new{k}"
            rows.append((100 + 10 * i + k, " ".join(copy)))
    for i, t in enumerate(base[6:9]):  # alike, but well below 0.8: they stay
        words = t.split()
        for k in draw.sample(range(300), 25):
            words[k] = "other"
        rows.append((400 + i, " ".join(words)))
    rows += [(3, base[3]), (200, base[4]), (300, None), (301, ""), (302, None), (None, "lonely text"), (None, "lonely text")]
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, _h int")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [*range(12), 300, 400, 401, 402, None]))
    assert simhash.deduplicate(docs.limit(0)).count() == 0 and simhash.classes(docs.limit(0)).count() == 0


def shingles(text, words=5):
    found = text.encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def alike(a, b):
    """Whether two shingle sets have a Jaccard similarity of 0.8 or more."""
    return 5 * len(a & b) >= 4 * len(a | b) > 0


def check_groups(spark, texts, **how):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    scratch = Scratch(spark, "t")
    root = {r.h: r.root for r in simhash.similar(docs.select(F.xxhash64("text").alias("h"), F.col("text").alias("t")), scratch, **how).collect()}
    hashes = [r.h for r in docs.select(F.xxhash64("text").alias("h")).collect()]
    sets = [shingles(t) for t in texts]
    label = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    got = [root.get(h, h) for h in hashes]
    assert len(set(zip(got, label))) == len(set(got)) == len(set(label))
    return label


def invented(draw, n):
    return ["".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 8])
def test_dedup_finds_every_pair(spark, block):
    """Pairs of two about and at 0.8, and texts of 8 and 9 words, against brute force."""
    draw = random.Random(11)
    texts = []
    for k in range(150):  # 2 * 5 shingles of 100 to 140 differ for each word changed: 0.74 to 0.90
        words = invented(draw, 100 + k % 40)
        copy = list(words)
        for at in draw.sample(range(0, len(words), 10), 2 + k % 3):
            copy[at] = "other"
        texts += [" ".join(words), " ".join(copy)]
    for _ in range(60):
        words = invented(draw, 9)
        texts += [" ".join(words[:8]), " ".join(words)]
    label = check_groups(spark, texts, block=block)
    assert all(label[i + 1] == i for i in range(300, 420, 2)) and len(set(label)) > 220


@pytest.mark.parametrize("block", [4096, 8])
def test_dedup_bridges_crowds(spark, block):
    """Two crowds, each a chain of near copies, that one pair alone connects, and crowds just below 0.8."""
    draw = random.Random(12)
    texts = []
    for bridge in (True, False):
        words = invented(draw, 260)
        windows = [words[at : at + 200] for at in range(0, 61, 2)]  # a chain: neighbours alike, the ends not
        far = [[*words[60:260], *invented(draw, 49 if bridge else 60)]]  # 196 of 245 shingles: 0.8, of the last window only
        for _ in range(30):
            copy = list(far[0])
            copy[100] = invented(draw, 1)[0]
            far.append(copy)
        texts += [" ".join(w) for w in [*windows, *far]]
    label = check_groups(spark, texts, block=block)
    assert len(set(label)) == 3
    template = invented(draw, 170)  # many neighbours below 0.8 that share most shingles, a few above
    crowd = [[*template, *invented(draw, 25)] for _ in range(60)]
    crowd += [[*c[:190], *invented(draw, 5)] for c in crowd[:10]]
    check_groups(spark, [" ".join(c) for c in crowd], block=block)


def test_dedup_of_a_crowd(spark):
    """5,000 near copies of one text, most pairs of them below 0.8: classes are the components of all pairs at 0.8 or more."""
    draw = random.Random(13)
    template, texts = invented(draw, 64), set()
    while len(texts) < 5000:
        copy = list(template)
        for at in draw.sample(range(64), draw.choice([1, 2, 2, 3, 3, 4])):
            copy[at] = "other"
        texts.add(" ".join(copy))
    texts = sorted(texts)
    number: dict = {}
    sets = [[number.setdefault(x, len(number)) for x in shingles(t)] for t in texts]
    has = np.zeros((len(texts), len(number)), np.float32)
    for row, s in zip(has, sets):
        row[s] = 1
    both, sizes = has @ has.T, has.sum(1)
    pairs = np.argwhere(5 * both >= 4 * (sizes[:, None] + sizes[None] - both))
    label = groups(len(texts), [(i, j) for i, j in pairs.tolist() if j < i])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == set(label) and 1 < len(kept) < 4000


def test_components(spark):
    draw = random.Random(9)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (500, 400)] + [(900, x) for x in range(901, 960)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    label = groups(1000, pairs)
    assert got == {x: label[x] for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t")).count() == 0


# ---- vectors ------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    vectors = [list(map(float, c + 0.08 * rng.normal(size=16))) for c in centres for _ in range(rng.integers(1, 6))]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [None] + [1.0] * 15]
    ids = list(range(1000, 1000 + len(vectors)))
    rows = vector_graph.near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>, component string")).collect()
    got = {r.vec_id: r for r in rows}
    sound = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    pairs = [(i, j) for i in sound for j in sound if j < i and cos(vectors[i], vectors[j])]
    links = Counter(x for p in pairs for x in p)
    found = sum(min(got[ids[i]].n_links, links[i]) for i in range(len(ids)))
    assert len(rows) == len(ids) and found >= 0.99 * sum(links.values()) and all(got[ids[i]].n_links <= links[i] for i in range(len(ids)))
    label = groups(len(ids), pairs)
    assert sum(got[ids[i]].component == ids[label[i]] for i in range(len(ids))) >= 0.99 * len(ids)
    assert all(r.kept == (r.vec_id == r.component) for r in rows)
    bad = [ids[i] for i in range(len(ids)) if i not in sound]
    assert all(got[i].n_links == 0 and got[i].component == i for i in bad)


def test_vector_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert vector_graph.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = vector_graph.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0]), (6, None)], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component, r.kept) for r in rows} == {(None, 1, 4, False), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True)}


def test_search_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    x = vector_graph.unit(np.concatenate([rng.normal(size=(400, 24)), np.repeat(rng.normal(size=(8, 24)), 40, 0) + 0.05 * rng.normal(size=(320, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(300, 24))]))
    want = set(map(tuple, np.argwhere((x @ x.T >= 0.9)).tolist()))
    for entry in (np.arange(len(x)), np.full(len(x), -1)):
        pairs: list = []
        vector_graph.search(x, x, vector_graph.pruned(x), 0.9, entry, lambda q, y: pairs.extend(zip(q.tolist(), y.tolist())))
        assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.97 * len(want)
    label, links = np.arange(len(x)), sorted(want)
    for part in (links[::2], links[1::2]):
        vector_graph.merge(label, *np.array(part).T)
    assert label.tolist() == groups(len(x), links)


def test_units_neither_overflow_nor_underflow(spark):
    rng = np.random.default_rng(8)
    near, far = rng.normal(size=16), rng.normal(size=16)
    rows = [near * f for f in (1.0, 1e-200, 1e200, 1e-310)] + [far * 1e-200, np.r_[1e-200 * np.ones(15), 1e200], np.full(16, 1e-323)]
    assert np.allclose(np.linalg.norm(vector_graph.unit(rows), axis=1), 1)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i].component for i in range(7)] == [0, 0, 0, 0, 4, 5, 6] and [got[i].n_links for i in range(7)] == [3, 3, 3, 3, 0, 0, 0]


def linked_by_brute_force(x):
    u = vector_graph.unit(x)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    return near.sum(1), groups(len(u), [(i, j) for i, j in np.argwhere(near).tolist() if j < i])


@pytest.mark.parametrize("way", ["graph", "every"])
def test_crowds_and_pairs_across_shards(spark, monkeypatch, way):
    """A crowd that fills many shards, and pairs that have none in common, are found over the united lists; so by all pairs."""
    monkeypatch.setattr(vector_graph, "PER_SHARD", 100)
    monkeypatch.setattr(vector_graph, "LARGE", 300)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=16) + 0.12 * rng.normal(size=(1500, 16)), rng.normal(size=(1000, 16))])
    x = np.concatenate([x, x[1500::4] + 0.1 * rng.normal(size=(250, 16))])
    nodes = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "h bigint, n bigint, v array<double>").repartition(4)
    links, label = linked_by_brute_force(x)
    if way == "graph":
        shards = {}
        for r in vector_graph.assigned(nodes, Scratch(spark, "t"), 2).collect():
            shards.setdefault(r.h, set()).add(r.shard)
        size = Counter(s for v in shards.values() for s in v)
        u = vector_graph.unit(x)
        apart = [(i, j) for i, j in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist() if not shards[i] & shards[j]]
        assert max(size.values()) <= 300 and len(size) > 20 and len(apart) > 1000
        counts, edges = vector_graph.link(nodes, 0.9, 2)
    else:
        counts, edges = vector_graph.every_pair(nodes, 0.9, 500)
    got = {r.h: r.n for r in counts.groupBy("h").agg(F.sum("links").alias("n")).collect()}
    assert all(got[i] <= links[i] for i in range(len(x)))
    shares = [got[i] / links[i] for i in range(len(x)) if links[i]]
    assert np.mean(shares) >= (0.98 if way == "graph" else 1)
    found = groups(len(x), [(r.u, r.v) for r in edges.collect()])
    assert sum(a == b for a, b in zip(found, label)) >= (0.98 if way == "graph" else 1) * len(x)


# ---- the pipeline -------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "123 456", "en", "src1", 7), (9003, "漢字 漢字 漢字", None, "src1", 9)], schema)
    short = spark.createDataFrame([(9004, "a", "en", "src1", 1), (9005, "Of!", None, None, 3)], schema)
    docs = docs.unionByName(extra).unionByName(short)
    kept = p.known_language(spark, docs, sf)
    assert kept.schema.names == schema.names and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002, 9003}
    once = p.without_copies(spark, kept, sf)
    texts = [r.text for r in once.collect()]
    assert len(texts) == len(set(texts)) and {r.text for r in kept.collect()} >= set(texts)
    mixed = p.mixed(spark, once, sf)
    assert mixed.columns == schema.names and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    rows = p.tokenized(spark, mixed, sf).collect()
    assert len(rows) == mixed.count() and all(r.n_tokens == len(r.ids) > 0 for r in rows)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    clash = docs.limit(40).selectExpr("*", "doc_id % 3 AS score", "'x' AS lang_pred", "2 AS phrase", "doc_id AS unknown", "doc_id AS h", "text AS t", "source AS root", "7 AS k")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns and all(r.score == r.doc_id % 3 and r.lang_pred == "x" and r.h == r.doc_id and r.root == r.source for r in out.collect())
    assert p.run(spark, sf).count() > 0 and len(p.STAGES) == 4
