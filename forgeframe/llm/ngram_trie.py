"""Language-model scoring with an Elias-Fano n-gram trie (operator 6).

Tokens are white-space words, A-Z in lower case, and one end for each text, which is also the
context of the first word. The model is a trigram model, interpolated with absolute discount::

    P(w)       = (c(w) + 1) / (N + V + 1)
    P(w | b)   = (n(b w) - D) / c(b) + bow(b) P(w)
    P(w | a b) = (n(a b w) - D) / n(a b) + bow(a b) P(w | b)

All n-grams count; ``least`` leaves those seen less often to the shorter context (none by
default). The terms are rounded down to 256 levels and each bow is what they leave, rounded down
too, so no context's probabilities sum to more than 1.

Every text is cut into words twice: once to count the vocabulary, once to number its words;
counting and scoring read the numbers, from a table that ``op6`` keeps for all documents.

Trie: the words of the vocabulary are numbered in the order of their 64-bit hash. A level holds
for each n-gram of the level above the words that follow it, sorted, as packed numbers, and their
terms as 8-bit codes; where each one's successors begin is a monotone sequence of pointers, stored
by Elias and Fano. A search selects two pointers and looks for the word among just the successors
between them. The bows of a level's contexts lie beside it, as 8-bit codes.

Levels are cut into shards, each written by one task into the shared folder; tasks map those that
they need (where the folder isn't mounted they read them, and keep ``OPEN`` at a time). Words are
cut by hash ranges of about ``SHARD`` tokens. What follows the contexts of a shard is one shard of
the next level, unless the contexts occur more often than that, as a very frequent word does: then
it is dealt over several by a hash of the following word, and the bows are put together afterwards.

Counting gathers from the whole corpus: every task sends its distinct n-grams, sorted, as
differences and compressed, to their shards, where they are merged. Raw counts are kept for words
only; those of bigrams are deleted when the trigrams are written.

Null texts count as empty: one token, the end. With no training text N = V = 0, and an empty
table gives an empty result. Very long texts are read whole, one at a time in a task. A word whose
hash another word has counts as that word (64 bits). Repeated rows count as often as they occur
and get equal scores; extra columns are kept, input columns named like an output column are
replaced.
"""

from __future__ import annotations

import bisect
import itertools
import math
import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from forgeframe.llm import _files
from forgeframe.llm._common import Scratch, delete, fresh, map_rows, tidied

DISCOUNT, SHARD, TOP_BITS, LEVELS, NONE = 0.75, 4_000_000, 16, 255, 255
FLUSH, OPEN, MANY = 4_000_000, 64, 256


# ---- Elias-Fano ---------------------------------------------------------------------------


def pack(values, bits: int):
    """Numbers of ``bits`` bits (0 to 63) one after another in 64-bit words."""
    import numpy as np

    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # numbers that begin in the same word are put together first
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        if len(first):
            out[word[first]] = np.bitwise_or.reduceat(values << off, first)
        over = off + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return out


def unpack(packed, bits: int, i):
    """Numbers i of ``pack``."""
    import numpy as np

    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(bits)
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    first = packed[word] >> off
    second = np.where(off > 0, packed[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    return (first | second) & np.uint64((1 << bits) - 1)


def placed() -> object:
    """Of each byte and k below 8: the place of its one number k."""
    import numpy as np

    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(ones)] = ones
    return out.ravel()


def directory(flags, count):
    """For ``select``: how many counted bits stand before each 64-bit word, and the word of every 64th of them."""
    import numpy as np

    before = np.r_[0, np.cumsum(count)[:-1]].astype(np.int64)
    total = int(before[-1] + count[-1]) if len(count) else 0
    return before, (np.searchsorted(before, np.arange(0, total + 64, 64), "right") - 1).astype(np.int32)


def select(flags, before, hint, table, k):
    """The places of ones number k of a bit string."""
    import numpy as np

    last, u = len(flags) - 1, np.uint64
    word = hint[k >> 6].astype(np.int64)
    lane = np.flatnonzero(before[np.minimum(word + 1, last)] <= k)
    if len(lane):  # very frequent words lie many words of the string apart
        word[lane] = np.searchsorted(before, k[lane], "right") - 1
    x, rank = flags[word], (k - before[word]).astype(u)
    # ones up to each byte, all bytes of a word at once
    sums = x - ((x >> u(1)) & u(0x5555555555555555))
    sums = (sums & u(0x3333333333333333)) + ((sums >> u(2)) & u(0x3333333333333333))
    sums = ((sums + (sums >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * u(0x0101010101010101)
    high = u(0x8080808080808080)
    shift = np.bitwise_count(((rank * u(0x0101010101010101)) | high) - sums & high).astype(u) << u(3)
    left = rank - (((sums << u(8)) >> shift) & u(255))
    byte = (x >> shift) & u(255)
    return (word << 6) + shift.astype(np.int64) + table[((byte << u(3)) | left).astype(np.int64)]


class Monotone:
    """A sorted sequence of unsigned integers by Elias and Fano."""

    def __init__(self, arrays: dict, name: str, table=None):
        self.low, self.high, self.before, self.hint = (arrays[f"{name}.{x}"] for x in ("low", "high", "before", "hint"))
        self.size, self.bits = (int(x) for x in arrays[f"{name}.shape"])
        self.table = placed() if table is None else table

    @staticmethod
    def build(values, name: str, flip: bool = False) -> dict:
        """values: sorted uint64. flip: for ``find``, which selects zeros; else for ``pair``, which selects ones."""
        import numpy as np

        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high_of = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros(-(-((int(high_of[-1]) if n else 0) + n + 2) // 64) * 64, np.uint8)
        flags[high_of + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        before, hint = directory(high, 64 - ones if flip else ones)
        return {f"{name}.low": pack(values & np.uint64((1 << bits) - 1), bits), f"{name}.high": high, f"{name}.before": before, f"{name}.hint": hint, f"{name}.shape": np.array([n, bits], np.int64)}

    def pair(self, i):
        """Elements i and i + 1."""
        import numpy as np

        u = np.uint64
        place = select(self.high, self.before, self.hint, self.table, i)
        rest = (self.high[place >> 6] >> (place & 63).astype(u)) >> u(1)
        after = place + 1 + np.bitwise_count((rest & (~rest + u(1))) - u(1)).astype(np.int64)  # the next one of the same word
        none = np.flatnonzero(rest == 0)
        if len(none):
            after[none] = select(self.high, self.before, self.hint, self.table, i[none] + 1)
        one, two = (place - i) << self.bits, (after - i - 1) << self.bits
        if self.bits:
            one, two = one | self.lows(i).astype(np.int64), two | self.lows(i + 1).astype(np.int64)
        return one, two

    def lows(self, i):
        """The low bits of elements i."""
        return unpack(self.low, self.bits, i)

    def zero(self, k):
        """The place of zero number k in the high bits."""
        return select(self.inverse(), self.before, self.hint, self.table, k)

    def inverse(self):
        if not hasattr(self, "_inverse"):
            self._inverse = ~self.high
        return self._inverse

    def find(self, values):
        """The positions of values (uint64), -1 for those that aren't there."""
        import numpy as np

        out = np.full(len(values), -1, np.int64)
        if not self.size or not len(values):
            return out
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        n_zeros = int(self.before[-1]) + 64 - int(np.bitwise_count(self.high[-1]))
        lane = np.flatnonzero((high >= 0) & (high < n_zeros))  # of 64 bits, the highest turn negative
        high = high[lane]
        want = values[lane] & np.uint64((1 << self.bits) - 1)
        begin = np.where(high > 0, self.zero(np.maximum(high - 1, 0)) + 1, 0)
        some = ((self.high[begin >> 6] >> (begin & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        lane, high, want, begin = lane[some], high[some], want[some], begin[some]
        at = begin - high
        first = self.lows(at)
        hit = first == want
        out[lane[hit]] = at[hit]
        more = first < want
        lane, high, want, low = lane[more], high[more], want[more], at[more] + 1
        if not len(lane):
            return out
        top = self.zero(high) - high  # one past the last element of that high part
        while len(lane):
            go = low < top
            lane, want, low, top = lane[go], want[go], low[go], top[go]
            if not len(lane):
                break
            middle = (low + top) >> 1
            seen = self.lows(middle)
            hit = seen == want
            out[lane[hit]] = middle[hit]
            low, top = np.where(seen < want, middle + 1, low), np.where(seen < want, top, middle)
            go = ~hit
            lane, want, low, top = lane[go], want[go], low[go], top[go]
        return out


def coded(x, name: str) -> dict:
    """Codes 0 to 254 of numbers in (0, 1], rounded down on a logarithmic scale, and the numbers of the codes."""
    import numpy as np

    logs = np.log10(x) if len(x) else np.zeros(0)
    least = float(logs.min()) if len(x) else -1.0
    step = max(-least, 1e-9) / (LEVELS - 1)
    code = np.minimum(np.floor((logs - least) / step + 1e-9), LEVELS - 1)
    scale = 10 ** (least + step * np.arange(LEVELS))
    scale[-1] = min(1.0, scale[-1])
    return {f"{name}.code": code.astype(np.uint8), f"{name}.scale": np.append(scale, 1.0)}


# ---- tokens -------------------------------------------------------------------------------

ROOT, ROOT_INVERSE, MIX = 0x9E3779B97F4A7C15, 0xF1DE83E19937733D, 0xBF58476D1CE4E5B9
#: The hash of the end of a text.
END = -0x1E4D


class Tokens:
    """Cuts texts into tokens and hashes them, all of a block at once.

    The hash of a word is a polynomial over its bytes modulo 2**64, from differences of one
    running sum, mixed with its length.
    """

    def __init__(self):
        import numpy as np

        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, texts: list[str | None]):
        """Hashes (int64) of all words in order, and how many words each text has."""
        import numpy as np

        raw = [(t or "").encode().lower() for t in texts]
        joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if len(self.power) < len(joined):
            one = np.ones(len(joined), np.uint64)
            one[1:] = ROOT
            self.power = np.cumprod(one)
            one[1:] = ROOT_INVERSE
            self.inverse = np.cumprod(one)
        word = ~self.space[joined]
        turn = np.diff(word.view(np.int8), prepend=np.int8(0))
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = joined.astype(np.uint64)
        sums += np.uint64(1)
        sums *= self.power[: len(joined)]
        np.cumsum(sums, out=sums)
        h = (sums[end - 1] - np.where(begin > 0, sums[np.maximum(begin - 1, 0)], np.uint64(0))) * self.inverse[begin]
        h += (end - begin).astype(np.uint64) * np.uint64(ROOT)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX)
        h ^= h >> np.uint64(31)
        edge = np.cumsum([0, *[len(r) + 1 for r in raw]])
        return h.view(np.int64), np.diff(np.searchsorted(begin, edge))


# ---- the trie -----------------------------------------------------------------------------


class Trie:
    """The mapped shards of a model. shape: dict with path, tokens (N), words (V), bits of a word's number, cuts and
    offsets of the words' shards; for levels 2 and 3, children: where the children of each shard above begin (and the
    end), salt: the bits by which following words are dealt over them."""

    def __init__(self, shape: dict):
        import numpy as np

        self.shape = shape
        self.cuts = np.array(shape["cuts"], np.int64)  # first bucket of each shard
        self.offsets = np.array(shape["offsets"], np.int64)
        self.children = {n: np.array(x, np.int64) for n, x in shape.get("children", {}).items()}
        self.salt = {n: np.array(x, np.int64) for n, x in shape.get("salt", {}).items()}
        self.opened, self.table = {}, placed()
        self.mapped = _files.mounted(shape["path"]) is not None
        self.tokens = Tokens()
        self.end = self.words(np.array([END], np.int64))[0]

    def file(self, name: str) -> dict:
        if name not in self.opened:
            if not self.mapped and len(self.opened) >= OPEN:
                self.opened.pop(next(iter(self.opened)))
            a = self.opened[name] = _files.load(posixpath.join(self.shape["path"], name))
            a |= {k: Monotone(a, k, self.table) for k in ("from", "keys") if f"{k}.high" in a}
        return self.opened[name]

    def parted(self, ids, lane):
        """(id, its part of lane) for each id that lane has."""
        import numpy as np

        if not len(lane):
            return []
        mine = ids[lane]
        if mine.min() == mine.max():
            return [(int(mine[0]), lane)]
        order = np.argsort(mine.astype(np.uint16) if mine.max() < 1 << 16 else mine, kind="stable")
        lane, mine = lane[order], mine[order]
        edge = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1, len(mine)]
        return [(int(mine[a]), lane[a:z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def words(self, h):
        """Numbers of hashes of words, -1: unknown."""
        import numpy as np

        ids = np.full(len(h), -1, np.int64)
        for s, lane in self.parted(np.searchsorted(self.cuts, bucket(h), "right") - 1, np.arange(len(h))):
            if self.offsets[s] == self.offsets[s + 1]:
                continue
            a = self.file(f"level1-{s}")
            at = a["keys"].find(relative(h[lane], int(a["base"][0])))
            ids[lane] = np.where(at >= 0, at + self.offsets[s], -1)
        return ids

    def number(self, texts: list[str | None]) -> list[bytes]:
        """The numbers of each text's words, as bytes of int32 (int64 for vocabularies over 2**31)."""
        import numpy as np

        h, sizes = self.tokens(texts)
        distinct, place = np.unique(h, return_inverse=True)
        ids = self.words(distinct)[place].astype(self.kind())
        edge = np.cumsum(np.r_[0, sizes])
        return [ids[a:z].tobytes() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def kind(self):
        return "<i4" if self.shape["words"] < 2**31 else "<i8"

    def sequence(self, numbered: list[bytes]):
        """All tokens of texts, each between ends; where texts begin, and their lengths with both ends."""
        import numpy as np

        size = np.dtype(self.kind()).itemsize
        sizes = np.array([len(b) // size + 2 for b in numbered], np.int64)
        first = np.cumsum(np.r_[0, sizes])[:-1]
        ids = np.full(int(sizes.sum()), self.end, np.int64)
        inside = np.ones(len(ids), bool)
        inside[first] = inside[first + sizes - 1] = False
        ids[inside] = np.frombuffer(b"".join(numbered), self.kind())
        return ids, first, sizes

    def home(self, ids):
        """Shard of words and their numbers within it (-1: unknown)."""
        import numpy as np

        if len(self.offsets) == 2:
            return np.zeros(len(ids), np.int64), ids
        shard = np.maximum(np.searchsorted(self.offsets, ids, "right") - 1, 0)
        return shard, np.where(ids >= 0, ids - self.offsets[shard], -1)

    def child(self, n: int, parent, word):
        """The shard of level n that holds a word after a context of shard ``parent`` of the level above."""
        import numpy as np

        salt = self.salt[n][parent]
        if not salt.any():
            return self.children[n][parent]
        mixed = np.maximum(word, 0).astype(np.uint64) * np.uint64(ROOT)
        return self.children[n][parent] + np.where(salt > 0, (mixed >> np.uint64(32)).astype(np.int64) >> (32 - salt), 0)

    def step(self, n: int, parent, context, word):
        """Level n at (context of shard parent, word): shard and position (-1: absent), term, and the context's bow (1: no such context)."""
        import numpy as np

        at, term, bow = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        child = self.child(n, parent, word)
        bits = np.uint64(self.shape["bits"])
        for c, lane in self.parted(child, np.flatnonzero(context >= 0)):
            # equal n-grams are looked up once, contexts too, and in their order in the shard
            key = (context[lane].astype(np.uint64) << bits) | (word[lane] + 1).astype(np.uint64)
            order = np.argsort(key)
            lane, key = lane[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            of, key = np.cumsum(new) - 1, key[new]
            owner = (key >> bits).astype(np.int64)
            bows = self.file(f"bows{n}-{int(parent[lane[0]])}")
            code = bows["bow.code"][owner]
            bow[lane] = bows["bow.scale"][code][of]
            want = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64) - 1
            live = np.flatnonzero((code != NONE) & (want >= 0))
            if len(live):
                a = self.file(f"level{n}-{c}")
                found, terms = np.full(len(key), -1, np.int64), np.zeros(len(key))
                found[live] = self.among(a, owner[live], want[live])
                hit = np.flatnonzero(found >= 0)
                terms[hit] = a["term.scale"][a["term.code"][found[hit]]]
                at[lane], term[lane] = found[of], terms[of]
        return child, at, term, bow

    def among(self, a: dict, context, word):
        """The positions of words among the successors of contexts (sorted) in a shard, -1: absent."""
        import numpy as np

        out, bits = np.full(len(word), -1, np.int64), self.shape["bits"]
        new = np.r_[True, context[1:] != context[:-1]]
        of = np.cumsum(new) - 1
        low, top = (x[of] for x in a["from"].pair(context[new]))
        live = np.flatnonzero(low < top)
        low, top, word = low[live], top[live], word[live]
        # words are numbered by their hash, so successors lie evenly and a guess by proportion is nearly right
        least, most, turn = np.zeros(len(live), np.int64), np.full(len(live), self.shape["words"], np.int64), 0
        while len(live):
            if turn % 4 < 3:
                middle = np.minimum(low + ((word - least) / (most - least) * (top - low)).astype(np.int64), top - 1)
            else:
                middle = (low + top) >> 1
            seen = unpack(a["words"], bits, middle).astype(np.int64)
            hit = np.flatnonzero(seen == word)
            out[live[hit]] = middle[hit]
            less = seen < word
            low, top = np.where(less, middle + 1, low), np.where(less, top, middle)
            top[hit] = low[hit]
            go = np.flatnonzero(low < top)
            live, low, top, word, least, most, less, seen = (x[go] for x in (live, low, top, word, least, most, less, seen))
            least, most = np.where(less, seen + 1, least), np.where(less, most, seen)
            turn += 1
        return out

    def before(self, shard, at, first):
        """Shard and position of what ends before each token; absent where a text begins."""
        import numpy as np

        shard, at = np.r_[0, shard[:-1]], np.r_[-1, at[:-1]]
        at[first] = -1
        return shard, at

    def score(self, numbered: list[bytes]):
        """Tokens, known tokens, base score and score (both log10) of each text."""
        import numpy as np

        ids, first, sizes = self.sequence(numbered)
        n_all, n_words = self.shape["tokens"], self.shape["words"]
        counts = np.zeros(len(ids), np.int64)
        shard, own = self.home(ids)
        for s, lane in self.parted(shard, np.flatnonzero(own >= 0)):
            counts[lane] = self.file(f"level1-{s}")["n"][own[lane]]
        single = (counts + 1) / (n_all + n_words + 1)
        p = single
        if n_all:
            shard, at, term, bow = self.step(2, *self.before(shard, own, first), ids)
            p = term + bow * single
            _, _, term, bow = self.step(3, *self.before(shard, at, first), ids)
            p = term + bow * p
        real = np.ones(len(ids), bool)
        real[first] = False
        add = lambda x: np.add.reduceat(np.where(real, x, 0), first)
        return sizes - 1, add(counts > 0), add(np.log10(single)), add(np.log10(p))


def block_bytes(shape: dict) -> int:
    """Bytes of numbered words that a task looks up at once; with many shards more, as every block asks nearly all of them."""
    return 3 << 20 if len(shape["cuts"]) <= MANY else 6 << 20


def bucket(h):
    return (h >> (64 - TOP_BITS)) + (1 << (TOP_BITS - 1))


def relative(h, base: int):
    """h - base as unsigned."""
    import numpy as np

    return h.view(np.uint64) - np.int64(base).view(np.uint64)


def packed(keys, counts) -> bytes:
    """Sorted keys as differences in byte planes, counts, compressed."""
    import numpy as np
    import pyarrow as pa

    step = np.diff(keys, prepend=np.uint64(0))
    raw = step.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).tobytes()  # a task sends before it has 2**32
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(blob: bytes):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n, asbytes=True), np.uint8)
    k = n // 12
    step = np.ascontiguousarray(raw[: 8 * k].reshape(8, k).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64), raw[8 * k :].view(np.uint32).astype(np.int64)


def united(parts, least: int = 1):
    """Sorted distinct keys of several (keys, counts) that occur ``least`` times or more in all, and their counts."""
    import numpy as np

    # most counts are 1: those keys are only sorted, which is much faster than sorting pairs
    keys, counts = np.unique(np.concatenate([k[c == 1] for k, c in parts]), return_counts=True)
    more, n = np.concatenate([k[c > 1] for k, c in parts]), np.concatenate([c[c > 1] for _, c in parts])
    if len(more):
        order = np.argsort(more)
        more, n = more[order], n[order]
        first = np.flatnonzero(np.r_[True, more[1:] != more[:-1]])
        more, n = more[first], np.add.reduceat(n, first)
        at = np.searchsorted(keys, more)
        both = keys[np.minimum(at, len(keys) - 1)] == more if len(keys) else np.zeros(len(more), bool)
        counts[at[both]] += n[both]
        keys, counts = np.insert(keys, at[~both], more[~both]), np.insert(counts, at[~both], n[~both])
    if least > 1:
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys, counts


# ---- building -----------------------------------------------------------------------------


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): hash and count of each token."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        tokens, held, size, ends = Tokens(), [], 0, 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            step = max(1, int(b.num_rows * (2 << 20) / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                part = b.column(0).slice(at, step).to_pylist()
                ends += len(part)
                held.append(tokens(part)[0])
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    size = 0
        if held:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([ends], pa.int64())], ["h", "n"])

    return docs.select(text).mapInArrow(tidied(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def merged(rows: DataFrame, finish, schema: str) -> DataFrame:
    """Rows sorted by shard, all of one shard given to ``finish(shard, batch columns)`` at once."""
    import pyarrow as pa

    names = rows.columns[1:]
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches):
        now, held = None, []

        def out():
            if now is not None:
                found = finish(now, [pa.concat_arrays([b.column(n) for b in held]) for n in names])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in found], [f[0] for f in fields])

        for b in batches:
            shards = b.column("shard").to_pylist()
            at = 0
            while at < len(shards):
                to = bisect.bisect_right(shards, shards[at])
                if shards[at] != now:
                    yield from out()
                    now, held = shards[at], []
                held.append(b.slice(at, to - at))
                at = to
        yield from out()

    return rows.mapInArrow(tidied(run), schema)


def dealt(df: DataFrame, shards: int, *order: str) -> DataFrame:
    return df.repartition(shards, "shard").sortWithinPartitions("shard", *order)


def level_of(keys, counts, whole, bits: int) -> tuple[dict, object]:
    """The arrays of a shard from its n-grams, and what the terms of each context sum to (0: no successor)."""
    import numpy as np

    context = (keys >> np.uint64(bits)).astype(np.int64)
    terms = coded((counts - DISCOUNT) / whole[context], "term")
    begins = np.searchsorted(context, np.arange(len(whole) + 1)).astype(np.uint64)
    used = np.bincount(context, terms["term.scale"][terms["term.code"]], len(whole))
    return Monotone.build(begins, "from") | terms | {"words": pack(keys & np.uint64((1 << bits) - 1), bits)}, used


def bows_of(used) -> dict:
    """Codes of what the terms of each context leave (NONE: no successor)."""
    import numpy as np

    some = used > 0
    bows = coded(np.maximum(1e-9, 1 - used[some]), "bow")
    code = np.full(len(used), NONE, np.uint8)
    code[some] = bows["bow.code"]
    return bows | {"bow.code": code}


def count_grams(numbered: DataFrame, shape: dict, n: int) -> DataFrame:
    """(shard, grams): packed sorted n-grams of each task and shard, from (words)."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        trie = Trie(shape)
        held: dict[int, list] = {}
        size = 0

        def out():
            rows = [(s, packed(*np.unique(np.concatenate(v), return_counts=True))) for s, v in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.binary())], ["shard", "grams"])

        for b in batches:
            step = max(1, int(b.num_rows * block_bytes(shape) / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                ids, first, _ = trie.sequence(b.column(0).slice(at, step).to_pylist())
                parent, context = trie.before(*trie.home(ids), first)
                if n == 3:
                    parent, context = trie.before(*trie.step(2, parent, context, ids)[:2], first)
                shard = trie.child(n, parent, ids)
                key = (context.astype(np.uint64) << np.uint64(shape["bits"])) | ids.astype(np.uint64)
                for s, lane in trie.parted(shard, np.flatnonzero(context >= 0)):
                    held.setdefault(s, []).append(key[lane])
                    size += len(lane)
                if size > FLUSH:
                    yield out()
                    size = 0
        yield out()

    return numbered.select("words").mapInArrow(tidied(run), "shard bigint, grams binary")


def number(docs: DataFrame, shape: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and words: the numbers of each whole text's words, as bytes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "words"]
    rows = docs.select(*keep, F.col(text).alias(fresh("text")))

    def make():
        trie = Trie(shape)
        return lambda columns: [trie.number(columns[0])]

    return map_rows(rows, StructType([*[docs.schema[c] for c in keep], StructField("words", BinaryType())]), make, through=len(keep))


def train_words(docs: DataFrame, text: str = "text", shard_tokens: int | None = None) -> dict:
    """Counts the words of ``docs`` and writes level 1; returns the shape that ``number`` and ``train_grams`` need."""
    spark, shard_tokens = docs.sparkSession, shard_tokens or SHARD
    scratch = Scratch(spark, "ngrams")
    path = posixpath.join(scratch.path, "trie")
    words = scratch.table(vocabulary(docs, text), "words")
    range_of = F.expr(f"shiftright(h, {64 - TOP_BITS}) + {1 << (TOP_BITS - 1)}").cast("int")
    sums = {r.b: (r.n, r.v) for r in words.groupBy(range_of.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # at most 2**TOP_BITS hash ranges
    tokens, n_words = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    cuts, loads, offsets = [0], [0], [0, 0]
    for b in sorted(sums):
        if loads[-1] and loads[-1] + sums[b][0] > shard_tokens:
            cuts.append(b)
            loads.append(0)
            offsets.append(offsets[-1])
        loads[-1] += sums[b][0]
        offsets[-1] += sums[b][1]
    shape = {"path": path, "tokens": int(tokens), "words": int(n_words), "cuts": cuts, "offsets": offsets, "bits": max(1, int(n_words).bit_length()), "shard": shard_tokens, "load": loads}
    if not tokens:
        return shape
    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            shard = np.searchsorted(cuts, bucket(b.column("h").to_numpy(zero_copy_only=False)), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), b.column("h"), b.column("n")], ["shard", "h", "n"])

    numbered = words.mapInArrow(tidied(place), "shard bigint, h bigint, n bigint")

    def write_words(s, columns):
        import numpy as np

        h, n = (c.to_numpy(zero_copy_only=False) for c in columns)
        base = int(h[0])
        _files.save(posixpath.join(path, f"level1-{s}"), Monotone.build(relative(h, base), "keys", flip=True) | {"n": n.astype(np.int64), "base": np.array([base], np.int64)})
        return s, len(h)

    merged(dealt(numbered, len(cuts), "h"), write_words, "shard bigint, n bigint").agg(F.sum("n")).collect()
    scratch.drop("words")
    return shape


def dealt_over(loads: list[int], shard: int) -> tuple[list[int], list[int]]:
    """For shards of these loads (tokens): where each one's children begin (and the end), and the bits that choose among them."""
    salt = [min(32, max(0, math.ceil(math.log2(x / shard)))) if x > shard else 0 for x in loads]
    return list(itertools.accumulate((1 << x for x in salt), initial=0)), salt


def train_grams(numbered: DataFrame, shape: dict, least: int = 1) -> dict:
    """Counts the n-grams of (words) from ``number`` and writes the upper levels; returns the whole shape.

    least: n-grams seen less often are left to the shorter context.
    """
    path, spark = shape["path"], numbered.sparkSession
    if not shape["tokens"]:
        return shape
    at = lambda name: posixpath.join(path, name)
    loads = shape["load"]
    live = [s for s in range(len(loads)) if shape["offsets"][s + 1] > shape["offsets"][s]]
    for order in (2, 3):
        first, salt = dealt_over(loads, shape["shard"])
        shape = shape | {"children": shape.get("children", {}) | {order: first}, "salt": shape.get("salt", {}) | {order: salt}}

        def write(s, columns, order=order, first=first, salt=salt, bits=shape["bits"]):
            keys, counts = united([unpacked(b) for b in columns[0].to_pylist()], least)
            parent = bisect.bisect_right(first, s) - 1
            whole = _files.load(at(f"level1-{parent}" if order == 2 else f"building/counts-{parent}"))["n"]
            found, used = level_of(keys, counts, whole, bits)
            _files.save(at(f"level{order}-{s}"), found)
            if salt[parent]:
                _files.save(at(f"building/used{order}-{s}"), {"used": used})
            else:
                _files.save(at(f"bows{order}-{parent}"), bows_of(used))
            if order == 2:
                _files.save(at(f"building/counts-{s}"), {"n": counts.astype("<u4" if len(counts) == 0 or counts.max() < 2**32 else "<u8")})
            return s, len(keys), int(counts.sum())

        children = [c for p in live for c in range(first[p], first[p + 1])]
        every = spark.createDataFrame([(c, EMPTY) for c in children], "shard bigint, grams binary")  # so that every shard is written
        grams = count_grams(numbered, shape, order).unionByName(every)
        done = merged(dealt(grams, len(children)), write, "shard bigint, n bigint, load bigint").collect()  # one row a shard

        def join_bows(s, columns, order=order, first=first):
            used = sum(_files.load(at(f"building/used{order}-{c}"))["used"] for c in range(first[s], first[s + 1]))
            _files.save(at(f"bows{order}-{s}"), bows_of(used))
            return (s,)

        over = [p for p in live if salt[p]]
        if over:
            rows = spark.createDataFrame([(p, p) for p in over], "shard bigint, p bigint")
            merged(dealt(rows, len(over)), join_bows, "shard bigint").collect()
        live, loads = children, [0] * first[-1]
        for r in done:
            loads[r.shard] = r.load
    delete(spark, at("building"))
    return shape


def train(docs: DataFrame, text: str = "text", shard_tokens: int | None = None, least: int = 1) -> dict:
    """The shape of a trie trained on all of ``docs``."""
    shape = train_words(docs, text, shard_tokens)
    table = Scratch(docs.sparkSession, "numbered").table(number(docs, shape, text, []), "words")
    return train_grams(table, shape, least)


def _empty() -> bytes:
    import numpy as np

    return packed(np.zeros(0, np.uint64), np.zeros(0, np.int64))


EMPTY = bytearray(_empty())
SCORES = [("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType())]


def score_numbered(numbered: DataFrame, shape: dict) -> DataFrame:
    """Rows of ``number`` with n_tokens, n_known, base_score and score in place of words."""
    keep = [c for c in numbered.columns if c != "words"]

    def make():
        trie = Trie(shape)
        return lambda columns: [x.tolist() for x in trie.score(columns[0])] if columns[0] else [[]] * len(SCORES)

    return map_rows(numbered.select(*keep, "words"), StructType([*[numbered.schema[c] for c in keep], *[StructField(n, k) for n, k in SCORES]]), make, block_bytes(shape), len(keep))


def score(docs: DataFrame, shape: dict, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of each whole text."""
    own = [n for n, _ in SCORES]
    docs = docs.select(*[c for c in docs.columns if c not in own])
    return score_numbered(number(docs, shape, text), shape)
