"""Language ID by cross-parsing entropy (operator 4).

For each language a suffix automaton of labelled text is built. A text is parsed greedily
against each: a phrase is the longest match from where the last one ended, found by walking
the automaton. A language's cost is phrases * log2(sample length) / symbols, the bits that
pointers into the sample would take; the least cost wins, ties go to the smaller name.

Symbols are letters and marks (Unicode categories L and M) in lower case, everything between
them counts as one space; symbols that a sample doesn't have match nothing there. Whole texts
are parsed, however long: all texts and languages of a batch side by side in numpy, in blocks of
``BLOCK`` symbols that are first parsed as if a phrase began with each of them; then the phrase
that goes on over a block's start is followed until it meets a phrase of the block, so that the
result is that of one parse from the first symbol to the last.

The classifier is fitted on a bounded sample of labelled rows: of each language at most ``rows``
whole texts of ``longest`` characters or fewer, lowest hash first, as long as they have
``symbols`` in all; where a language has only longer ones, its shortest text. It knows the
``ALPHABET`` most frequent symbols of a sample. More than ``labels`` languages raise an error:
each needs an automaton in every task (2 MB for 70,000 symbols).

Null texts and texts without a letter: ``und`` with score 0. Without labelled texts all are
``und``. Score: how much cheaper the best language is than the second, 0 to 1 (1 if there is
one language). Rows with equal texts get equal values; equal labelled rows count once. An empty
table gives an empty result. Extra columns are kept; input columns named like an output column
are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from forgeframe.llm._common import fresh, map_rows

#: Columns that ``identify`` adds.
OWN = ["lang_pred", "score", "phrase", "unknown"]
ROWS, LONGEST, SYMBOLS, LABELS, ALPHABET, BLOCK = 16, 10_000, 60_000, 16, 255, 1024


def kinds():
    """For each code point: 2 a letter, 1 a mark, 0 anything else."""
    import numpy as np

    category = unicodedata.category
    of = {"L": 2, "M": 1}
    return np.array([of.get(category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def symbols(texts: list[str | None], kind):
    """Code points of all texts, lower-cased, one space between runs of letters and marks; how many each text
    has; 0 for texts without a letter."""
    import numpy as np

    lowered = [(t or "").lower() + "\n" for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    k = kind[points]
    owner = np.repeat(np.arange(len(texts)), size)
    lettered = np.bincount(owner[k == 2], minlength=len(texts)) > 0
    inside = k > 0
    # a gap is a space if something of the text stands before it and after it
    gap = ~inside & np.r_[False, inside[:-1]]
    last = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    last[owner[at]] = at
    keep = (inside | (gap & (np.arange(len(points)) < last[owner]))) & lettered[owner]
    points = np.where(inside, points, 32)[keep]
    return points, np.bincount(owner[keep], minlength=len(texts))


class Automaton:
    """Suffix automaton of a sequence of small integers, as a double array.

    A state is a place; what follows it by c stands at place + c, if ``owner`` has the state there, and is in
    ``next``. 0 is the root and no target. Nearly all states have one successor, so the array is about as long as there
    are successors, whatever the width. Each of 1 to width - 1 must be in the sequence: the root has them all.
    """

    def __init__(self, symbols: list[int], width: int):
        import numpy as np

        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    twin = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        place = places(nexts, width)
        state = np.repeat(place, [len(x) for x in nexts])
        self.owner = np.full(int(place.max()) + width, -1, np.int32)
        self.next = np.zeros(len(self.owner), np.int32)
        at = state + np.array([c for x in nexts for c in x], np.int64)
        self.owner[at], self.next[at] = state, place[np.array([t for x in nexts for t in x.values()], np.int64)]


def places(nexts: list[dict[int, int]], width: int, window: int = 4096, tries: int = 8):
    """A place of its own for each state, the root's 0, such that no two successors stand at one place."""
    import numpy as np

    count = np.array([len(x) for x in nexts])
    most = len(nexts) * 2 + int(count.sum()) * 2 + 4 * (window + width)
    free, unused, out = np.ones(most, bool), np.ones(most, bool), np.zeros(len(nexts), np.int64)
    free[0] = unused[0] = False
    free[list(nexts[0])] = False
    low = failed = 0
    for s in (np.argsort(-count[1:], kind="stable") + 1)[: int((count[1:] > 1).sum())].tolist():
        codes, at = list(nexts[s]), low
        while True:
            if at + window + width > len(free):
                free, unused = (np.r_[x, np.ones(len(x), bool)] for x in (free, unused))
            ok = unused[at : at + window].copy()
            for c in codes:
                ok &= free[at + c : at + c + window]
            first = int(ok.argmax())
            if ok[first]:
                break
            failed += at == low
            at += window
        if failed > tries:  # what is left there goes to states with one successor
            low, failed = low + window, 0
        out[s] = at + first
        unused[at + first] = False
        free[[at + first + c for c in codes]] = False
    by: dict[int, list[int]] = {}
    for s, x in enumerate(nexts[1:], 1):
        if len(x) < 2:
            by.setdefault(next(iter(x), -1), []).append(s)
    for c, states in by.items():
        spare = len(states) + width
        free, unused = (np.r_[x, np.ones(spare, bool)] for x in (free, unused))
        found = np.flatnonzero(unused if c < 0 else unused[: len(unused) - c] & free[c:])[: len(states)]
        out[states] = found
        unused[found] = False
        if c >= 0:
            free[found + c] = False
    return out


class Classifier:
    """Automata of all languages. samples: (language, text) in a fixed order; most: symbols a language, in whole texts."""

    def __init__(self, samples: list[tuple[str, str]], most: int = SYMBOLS):
        import numpy as np

        self.kind = kinds()
        by: dict[str, list[int]] = {}
        for lang, text in samples:
            found = symbols([text], self.kind)[0].tolist()
            if found and (lang not in by or len(by[lang]) + len(found) < most):
                by[lang] = [*by[lang], 32, *found] if lang in by else found
        self.langs = sorted(by)
        self.code = np.zeros((max(1, len(by)), 0x110000), np.uint8)  # 0: symbols that the sample doesn't have
        made = []
        for i, lang in enumerate(self.langs):
            known = [c for c, _ in sorted(Counter(by[lang]).items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]]
            self.code[i, known] = np.arange(1, len(known) + 1)
            made.append(Automaton(self.code[i][by[lang]].tolist(), len(known) + 1))
        self.base = np.cumsum([0, *[len(a.next) for a in made]])[:-1].astype(np.int64)
        self.owner, self.next = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ([a.owner for a in made], [a.next for a in made]))
        self.bits = np.array([math.log2(max(2, len(by[k]))) for k in self.langs])

    def after(self, root, state):
        """What follows states by the symbols that stand at these places after the root; 0 for nothing."""
        import numpy as np

        at = root + state
        return np.where(self.owner[at] == state, self.next[at], 0)

    def phrases(self, points, size):
        """Phrases of each text in each language. points, size: as ``symbols`` gives them."""
        import numpy as np

        full = np.flatnonzero(size)
        out = np.zeros((len(self.langs), len(size)), np.int64)
        if not len(full) or not self.langs:
            return out
        codes = self.code[:, points]
        first = np.cumsum(np.r_[0, size])[:-1]
        blocks = -(-size // BLOCK)
        of = np.repeat(np.arange(len(size)), blocks)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(np.r_[0, blocks])[:-1], blocks)
        start, length = first[of] + inner * BLOCK, np.minimum(BLOCK, size[of] - inner * BLOCK)
        order = np.argsort(-length, kind="stable")
        base = self.base[:, None]
        state = np.zeros((len(self.langs), len(of)), np.int64)  # in the blocks' order by length
        begins = np.zeros(codes.shape, bool)  # whether a phrase begins with a symbol
        active = np.searchsorted(-length[order], -np.arange(int(length.max())), side="left")  # blocks longer than t
        by_length = start[order]
        for t, n in enumerate(active.tolist()):
            at = by_length[:n] + t
            root = base + codes[:, at]
            to = self.after(root, state[:, :n])
            miss = to == 0
            begins[:, at] = miss | (state[:, :n] == 0)
            state[:, :n] = np.where(miss, self.next[root], to)
        end = np.empty_like(state)
        end[:, order] = state
        # blocks into which a phrase goes on: follow it until both parses begin one at the same symbol
        lang, block = np.nonzero((inner > 0)[None, :] & (np.c_[np.zeros(len(self.langs), np.int64), end[:, :-1]] != 0))
        while len(block):
            now, live = end[lang, block - 1], np.arange(len(block))
            ended = []
            t = 0
            while len(live):
                over = t >= length[block[live]]
                if over.any():
                    ended.append(live[over])
                    live = live[~over]
                at = start[block[live]] + t
                row = lang[live]
                root = self.base[row] + codes[row, at]
                to = self.after(root, now[live])
                new = (to == 0) | (now[live] == 0)
                met = new & begins[row, at]
                begins[row, at] = new
                now[live] = np.where(to == 0, self.next[root], to)
                live = live[~met]
                t += 1
            # a phrase that goes on over a whole block changes what enters the next one
            done = np.concatenate(ended) if ended else np.zeros(0, np.int64)
            changed = done[end[lang[done], block[done]] != now[done]]
            end[lang[changed], block[changed]] = now[changed]
            lang, block = lang[changed], block[changed] + 1
            some = block < len(of)
            lang, block = lang[some], block[some]
            some = inner[block] > 0
            lang, block = lang[some], block[some]
        out[:, full] = np.add.reduceat(begins, first[full], axis=1, dtype=np.int64)
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """For each text: language, score, symbols in a phrase of that language, share of symbols that its sample doesn't have."""
        import numpy as np

        out: list[tuple[str, float, float, float]] = [("und", 0.0, 0.0, 1.0)] * len(texts)
        if not self.langs:
            return out
        points, size = symbols(texts, self.kind)
        count = self.phrases(points, size)
        cost = count * self.bits[:, None] / np.maximum(size, 1)
        best = np.argmin(cost, 0)
        strange = np.bincount(np.repeat(np.arange(len(texts)), size), self.code[np.repeat(best, size), points] == 0, len(texts)) / np.maximum(size, 1)
        ranked = np.sort(cost, 0)
        second = ranked[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        for i in np.flatnonzero(size).tolist():
            score = 1.0 if math.isinf(second[i]) else float(min(1.0, max(0.0, 1 - ranked[0, i] / max(second[i], 1e-12))))
            out[i] = (self.langs[best[i]], score, float(size[i] / max(1, count[best[i], i])), float(strange[i]))
        return out


def samples(labelled: DataFrame, text: str, lang: str, rows: int, longest: int, labels: int) -> list[tuple[str, str]]:
    """(language, whole text) of the bounded sample, in order of language and hash."""
    n = F.length(F.col(text))
    h = F.xxhash64(F.col(text))
    found = labelled.filter(F.col(lang).isNotNull() & (n > 0)).select(F.col(lang).cast("string").alias("lang"), h.alias("h"), n.alias("n")).distinct()
    # ranks on narrow rows; the rank filter is applied before and after the exchange
    over = F.col("n") > longest
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(over, F.when(over, F.col("n")).otherwise(0), "h"))).filter(F.col("r") <= rows)
    top = ranked.filter(~over | (F.col("r") == 1)).select("lang", "h").distinct().limit(labels * rows + 1).collect()
    if len({r.lang for r in top}) > labels or len(top) > labels * rows:
        raise ValueError(f"more than {labels} languages: pass a larger labels if its automata fit a task's memory")
    if not top:
        return []
    # at most labels * rows; from Arrow, as rows of Python would start workers of their own in all executors
    wanted = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array([r.lang for r in top], pa.string()), "h": pa.array([r.h for r in top], pa.int64())}))
    texts = labelled.select(F.col(lang).cast("string").alias("lang"), h.alias("h"), F.col(text).alias("t")).join(F.broadcast(wanted), ["lang", "h"])
    return [(r.lang, r.t) for r in sorted(texts.dropDuplicates(["lang", "h"]).collect(), key=lambda r: (r.lang, r.h))]


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS, longest: int = LONGEST, most: int = SYMBOLS, labels: int = LABELS) -> DataFrame:
    """``docs`` with lang_pred, score, phrase (mean symbols in a phrase) and unknown (share of symbols that the
    language's sample doesn't have), learned from ``labelled``."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in OWN or c == text])
    # built once, of a bounded sample: at most labels * (most + longest) symbols
    learned = spark.sparkContext.broadcast(vars(Classifier(samples(labelled, text, lang, rows, longest, labels), most)))  # plain arrays: workers need not have this module
    own = dict(zip(map(fresh, OWN), OWN))
    schema = StructType([*docs.schema.fields, *[StructField(c, k) for c, k in zip(own, (StringType(), DoubleType(), DoubleType(), DoubleType()))]])

    def make():
        classify = Classifier.__new__(Classifier)
        vars(classify).update(learned.value)

        def block(columns):
            found = classify(columns[0])
            return [list(x) for x in zip(*found)] if found else [[] for _ in OWN]

        return block

    at = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())
    out = map_rows(docs, schema, make, 1 << 19, len(docs.columns), [at])
    return out.drop(*[c for c in docs.columns if c in OWN]).withColumnsRenamed(own)
