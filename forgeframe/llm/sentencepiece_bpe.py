"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 10).

The model file is parsed here; the library is not used. A text is cut where no piece can
cross (before each run of spaces and around characters that no longer piece contains), each
distinct part is encoded once, and all parts of a block are encoded together: flat numpy
symbol arrays, the smallest pair rank of each part, all its leftmost occurrences merged at
once, the arrays compacted, until no pair remains.

Merging all occurrences at once equals the library's one-by-one agenda unless a merge makes a
pair of smaller rank; then the later occurrences of that part wait for the next round.

Nulls encode like the empty text: no ids. Very long texts are encoded whole, with a bound on the
parts that a task remembers. Empty tables give empty results. Order, ties and repeated rows need no rule; extra
columns are kept by ``encode`` under their own names.
"""

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts whose ids a task keeps, about 0.4 kB each.
KEPT = 100_000
NO_RANK = np.int32(2**31 - 1)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterable[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = struct.unpack("<d" if kind == 1 else "<f", b[i : i + n])[0], i + n
        else:
            raise ValueError(f"field type {kind} in a model file")
        yield tag >> 3, value


class Model:
    """A BPE model file with identity normalisation and byte fallback."""

    def __init__(self, blob: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        norm: dict = {}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only models with identity normalisation, a dummy prefix and plain pieces")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
        self.surface = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self._tables()

    def _tables(self) -> None:
        """Symbols: ids of pieces, then characters that only longer pieces contain, then one for all others."""
        n = len(self.pieces)
        long = [p for p in self.id_of if len(p) > 1]
        runs = {len(p) for p in self.id_of if set(p) == {SPACE}}
        worded = [p for p in long if set(p) != {SPACE}]
        if any(SPACE in p[1:] for p in worded):
            raise ValueError("a piece has a space inside; parts can't be encoded alone")
        if len({self.scores[self.id_of[p]] for p in worded}) != len(worded):
            raise ValueError("two pieces have one score; merges at once would need a tie rule")
        self.runs, self.runs_met = runs, {}
        extra = sorted({c for p in worded for c in p} - set(self.id_of))
        symbol = self.id_of | {c: n + i for i, c in enumerate(extra)}
        self.other = n + len(extra)
        self.width = self.other + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        order = sorted(worded, key=lambda p: -self.scores[self.id_of[p]])
        self.piece_of = np.array([self.id_of[p] for p in order], np.int32)
        pairs = sorted((symbol[p[:k]] * self.width + symbol[p[k:]], r) for r, p in enumerate(order) for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self._hash(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))
        merging = {c for p in worded for c in p}
        alone = "".join(f"\\x{i:02x}" for i in range(32) if chr(i) not in merging)
        #: A part: spaces and what follows up to the next space, or spaces, or one control character that never merges.
        self.parts = re.compile(rf"[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+" + (rf"|[{alone}]" if alone else ""))

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of pairs at a load of a quarter at most; -1: free."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        at = self._slot(keys)
        while len(keys):
            order = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[order], return_index=True)  # of several for one slot, the first
            put = order[one]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NO_RANK`` for those that no piece has."""
        key = a.astype(np.int64) * self.width + b
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.ranks[at], NO_RANK)
        left = np.flatnonzero((seen != key) & (seen != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.keys[at[left]]
            hit = seen == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out

    def run(self, k: int) -> tuple[int, ...]:
        """Ids of k spaces alone: all their pieces have one score, so the leftmost pair merges first."""
        if k not in self.runs_met:
            self.runs_met[k] = self._run(k)
        return self.runs_met[k]

    def _run(self, k: int) -> tuple[int, ...]:
        top = max(self.runs)
        sizes = [top] * (k // top) if all(top + x not in self.runs for x in self.runs) else []
        rest = [1] * (k - sum(sizes))
        while at := next((i + 1 for i in range(len(rest) - 1) if rest[i] + rest[i + 1] in self.runs), 0):
            rest[at - 1 : at + 1] = [rest[at - 1] + rest[at]]
        return tuple(self.id_of[SPACE * x] for x in sizes + rest)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, the word of each, and the code point of each that is one character."""
        text = "".join(words)
        char = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.of_char[char]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            n = len(sym)
            rank = np.full(n, NO_RANK, np.int32)
            if n > 1:
                rank[:-1] = np.where(word[1:] == word[:-1], self.rank(sym[:-1], sym[1:]), NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, n])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = least == NO_RANK
            if ended.any():
                done.append((sym[ended], word[ended], char[ended]))
                go = ~ended
                sym, word, char, rank, least = sym[go], word[go], char[go], rank[go], least[go]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, the leftmost; then every second one
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            start = np.r_[True, run[1:] != run[:-1]]
            odd = (np.arange(len(at)) - np.flatnonzero(start)[run - 1]) & 1
            at = at[odd == 0]
            w = word[at]
            if (w[1:] == w[:-1]).any():
                at = at[~self._waits(sym, word, rank, at)]
            sym[at] = self.piece_of[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, char = sym[keep], word[keep], char[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word, char = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order], char[order]

    def _waits(self, sym, word, rank, at) -> np.ndarray:
        """Which of the merges must wait: those after one, in the same word, that makes a pair of smaller rank."""
        new = self.piece_of[rank[at]]
        before = np.r_[False, (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]])]
        left_at = np.maximum(at - 1, 0)
        left = np.where(before, np.r_[0, new[:-1]], sym[left_at])
        has_left = (at > 0) & (word[left_at] == word[at])
        right_at = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[right_at] == word[at])
        smaller = (has_left & (self.rank(left, new) < rank[at])) | (has_right & (self.rank(new, sym[right_at]) < rank[at]))
        count = np.cumsum(smaller) - smaller  # of earlier merges that make one
        w = word[at]
        first = np.r_[True, w[1:] != w[:-1]]
        return count > count[np.flatnonzero(first)[np.cumsum(first) - 1]]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts as ``self.parts`` finds them."""
        bodies = [p.lstrip(" " + SPACE) for p in parts]
        lead = [len(p) - len(b) for p, b in zip(parts, bodies)]
        words = [SPACE + b if k and b else b for b, k in zip(bodies, lead)]
        sym, word, char = self.merge(words)
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        ids, at, out = sym.tolist(), 0, []
        n_pieces, lone = len(self.pieces), self.id_of[SPACE]
        has_other = np.zeros(len(words), bool)
        has_other[word[sym >= n_pieces]] = True
        for k, body, other, end in zip(lead, bodies, has_other.tolist(), ends):
            mine = ids[at:end]
            if other:
                mine = [x for j, s in enumerate(mine) for x in ([s] if s < n_pieces else self.byte_id[list(chr(char[at + j]).encode())].tolist())]
            at = end
            if k == 1 and body:  # by far the most: the space is part of the word
                out.append(mine)
            elif k and body:
                k, mine = (k, mine[1:]) if mine[0] == lone else (k - 1, mine)
                out.append([*self.run(k), *mine])
            else:
                out.append([*self.run(k)] if k else mine)
        return out

    def cut(self, text: str | None) -> list[str]:
        """The parts of a text, its dummy prefix included."""
        return self.parts.findall(" " + text) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.encode_parts(self.cut(text)) for i in part] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the dummy prefix is taken off again."""
        ids = list(ids)
        found = b"".join(map(self.surface.__getitem__, ids))
        opening = next((i for i in ids if self.kinds[i] not in (CONTROL, UNKNOWN)), None)
        stripped = opening is not None and self.kinds[opening] == NORMAL and found.startswith(b" ")
        return found[stripped:].decode("utf-8", "replace")


class Coder:
    """Encodes blocks of texts; keeps the ids and the decoded bytes of parts that it has met."""

    def __init__(self, blob: bytes, most: int = KEPT):
        import gc

        gc.set_threshold(200_000)  # no cycles are made here, and each look at the kept parts takes long
        self.model, self.most, self.met = Model(blob), most, {}
        self.digits = [str(i).encode() for i in range(len(self.model.pieces))]

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as decimal digits joined by commas, and what they decode to."""
        if len(self.met) > self.most:
            self.met.clear()
        cut = [self.model.cut(t) for t in texts]
        met = self.met
        found = [list(map(met.get, parts)) for parts in cut]
        new = list({p for parts, f in zip(cut, found) for p, x in zip(parts, f) if x is None})
        surface, digits = self.model.surface, self.digits
        for part, ids in zip(new, self.model.encode_parts(new) if new else []):
            met[part] = (b",".join([digits[i] for i in ids]), b"".join([surface[i] for i in ids]))
        out = []
        for parts, f in zip(cut, found):
            f = [met[p] if x is None else x for p, x in zip(parts, f)]
            out.append((b",".join([x[0] for x in f]), b"".join([x[1] for x in f])[1:]))
        return out


def encode(docs, model_path: str, text: str = "text", keep: list[str] | None = None):
    """The columns ``keep`` (all) of ``docs`` with n_tokens and ids (array of int): the ids of each whole text, none for null."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    blob = open(model_path, "rb").read()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids")]
    schema = StructType([*[docs.schema[c] for c in keep], StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        model, met = Model(blob), {}
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                cut = [model.cut(t) for t in rows.column(rows.num_columns - 1).to_pylist()]
                if len(met) > KEPT:
                    met.clear()
                new = list({p for parts in cut for p in parts if p not in met})
                met.update(zip(new, (np.array(x, np.int32).tobytes() for x in model.encode_parts(new)) if new else ()))
                found = [b"".join([met[p] for p in parts]) for parts in cut]
                size = np.array([len(x) // 4 for x in found], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(size), ids], [*keep, "n_tokens", "ids"])

    from pyspark.sql import functions as F

    from forgeframe.llm._common import fresh, tidied

    return docs.select(*keep, F.col(text).alias(fresh("text"))).mapInArrow(tidied(run), schema)


def decode(docs, model_path: str, ids: str = "ids"):
    """``docs`` with a column ``decoded``: the text of each row's ids; null ids decode to null."""
    from pyspark.sql import functions as F

    blob = open(model_path, "rb").read()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(blob)
        for rows in batches:
            yield pd.Series([None if r is None else model.decode(int(x) for x in r) for r in rows], dtype=object)

    return docs.withColumn("decoded", text(F.col(ids)))


def digest(docs, model_path: str, key: str = "doc_id", text: str = "text"):
    """key, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    from forgeframe.llm._common import map_rows

    blob = open(model_path, "rb").read()
    kind = dict(docs.dtypes)[key]

    def make():
        from hashlib import sha256

        coder = Coder(blob)

        def block(columns):
            keys, texts = columns
            found = coder(texts)
            return [keys, [a.count(b",") + 1 if a else 0 for a, _ in found], [sha256(a).hexdigest() for a, _ in found], [sha256(b).hexdigest() for _, b in found]]

        return block

    return map_rows(docs.select(key, text), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, 1 << 20)
