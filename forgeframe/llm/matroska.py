"""Matroska media columns: parse files into packet tables, and store bytes as 8-bit audio (operator 9).

The parser reads variable-length EBML elements (known and unknown sizes), track entries,
clusters, SimpleBlocks and BlockGroups with no, Xiph, fixed-size or EBML lacing, and cues, and
gives one packet for each frame: track, timestamp, byte range, key-frame flag, cluster. It
skips elements that it doesn't know, and raises ``ValueError`` on files that end inside an
element it needs. The writer makes a one-track PCM file (8 bits, 8000 Hz) with fixed-size
lacing in full blocks, EBML lacing in a last block of several frames, and a cue for each
cluster; equal bytes give equal files.

Null content: no packets. A broken file gives one row with its error and no packet. Null texts are
stored like empty ones, as 64 zero bytes; very long texts whole, one file at a time in a task, so a
task needs a few times its longest text. Repeated rows give equal files. Empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import DataFrame

from forgeframe.llm._common import map_rows

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_MAX, EBML_SIZE_MAX, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, CODEC, LACING, FRAME_NS, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE, CUE_TIME, CUE_WHERE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

UNIT, FRAMES, BLOCKS, RATE_HZ = 512, 8, 32, 8000


class Packet(NamedTuple):
    track: int
    timestamp_ms: float
    offset: int
    size: int
    key: bool
    cluster: int
    lacing: int


class File(NamedTuple):
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[float, int, int]]  # ms, track, position in the file
    clusters: list[int]
    duration_ms: float


# ---- reading ------------------------------------------------------------------------------


def vint(b: bytes, at: int, end: int, marked: bool = False) -> tuple[int, int, int]:
    """Value (with the length marker if ``marked``), position after it, its length."""
    if at >= end or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise ValueError(f"the file ends inside an integer at byte {at}")
    value = int.from_bytes(b[at : at + n], "big")
    return (value if marked else value & ((1 << (7 * n)) - 1)), at + n, n


def elements(b: bytes, at: int, end: int, open_ends: frozenset | set = frozenset()):
    """(id, start, end of the content); an unknown size reaches to the next element of ``open_ends`` or to the end."""
    while at < end:
        ident, at, _ = vint(b, at, end, True)
        size, at, n = vint(b, at, end)
        if size == (1 << (7 * n)) - 1:
            stop = end
            if ident == CLUSTER:
                stop = at
                while stop < end:
                    inner, x, _ = vint(b, stop, end, True)
                    if inner in open_ends:
                        break
                    more, x, _ = vint(b, x, end)
                    stop = x + more
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"the file ends inside element {ident:X}")
        yield ident, at, stop
        at = stop


def uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def real(b: bytes, a: int, z: int) -> float:
    return struct.unpack(">f" if z - a == 4 else ">d", b[a:z])[0] if z > a else 0.0


def laced(b: bytes, a: int, z: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's data."""
    if not kind:
        return [(a, z - a)]
    if a >= z:
        raise ValueError("a lace has no number of frames")
    n = b[a] + 1
    a += 1
    sizes: list[int] = []
    if kind == 2:
        if (z - a) % n:
            raise ValueError("frames of a fixed-size lace differ")
        sizes = [(z - a) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while a < z and b[a] == 255:
                size, a = size + 255, a + 1
            if a >= z:
                raise ValueError("a lace's sizes are longer than its block")
            sizes.append(size + b[a])
            a += 1
    else:
        for i in range(n - 1):
            value, a, length = vint(b, a, z)
            sizes.append(value if not i else sizes[-1] + value - ((1 << (7 * length - 1)) - 1))
    if kind != 2:
        sizes.append(z - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for s in sizes:
        out.append((a, s))
        a += s
    return out


def parse(b: bytes) -> File:
    """The packet table of a file."""
    tracks, packets, cues, clusters, scale, duration = [], [], [], [], 1_000_000, 0.0
    frame_ns: dict[int, int] = {}

    def block(a: int, z: int, at_ms: int, simple: bool, key: bool) -> None:
        track, a, _ = vint(b, a, z)
        if a + 3 > z:
            raise ValueError("a block ends inside its head")
        time, flags = struct.unpack(">hB", b[a : a + 3])
        kind = (flags >> 1) & 3
        key = bool(flags & 128) if simple else key
        start = (at_ms + time) * scale / 1e6
        for i, (o, s) in enumerate(laced(b, a + 3, z, kind)):
            packets.append(Packet(track, start + i * frame_ns.get(track, 0) / 1e6, o, s, key, len(clusters) - 1, kind))

    heads = list(elements(b, 0, len(b)))
    if not heads or heads[0][0] != EBML:
        raise ValueError("no EBML head")
    for ident, a, z in heads:
        if ident != SEGMENT:
            continue
        origin = a
        for ident, a, z in elements(b, a, z, TOP):
            if ident == INFO:
                for i, x, y in elements(b, a, z):
                    scale = uint(b, x, y) if i == SCALE else scale
                    duration = real(b, x, y) if i == DURATION else duration
            elif ident == TRACKS:
                for i, x, y in elements(b, a, z):
                    if i == TRACK:
                        t = {"number": 0, "kind": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0}
                        for j, p, q in elements(b, x, y):
                            if j in (NUMBER, KIND):
                                t["number" if j == NUMBER else "kind"] = uint(b, p, q)
                            elif j == CODEC:
                                t["codec"] = b[p:q].rstrip(b"\0").decode("ascii", "replace")
                            elif j == FRAME_NS:
                                t["frame_ns"] = uint(b, p, q)
                            elif j == AUDIO:
                                for k, u, v in elements(b, p, q):
                                    if k == RATE:
                                        t["rate"] = real(b, u, v)
                                    elif k in (CHANNELS, DEPTH):
                                        t["channels" if k == CHANNELS else "depth"] = uint(b, u, v)
                        frame_ns[t["number"]] = t.get("frame_ns", 0)
                        tracks.append(t)
            elif ident == CLUSTER:
                clusters.append(a)
                time = 0
                for i, x, y in elements(b, a, z):
                    if i == TIMESTAMP:
                        time = uint(b, x, y)
                    elif i == SIMPLE:
                        block(x, y, time, True, False)
                    elif i == GROUP:
                        inner = list(elements(b, x, y))
                        key = all(j != REFERENCE for j, _, _ in inner)
                        for j, p, q in inner:
                            if j == BLOCK:
                                block(p, q, time, False, key)
            elif ident == CUES:
                for i, x, y in elements(b, a, z):
                    if i == CUE:
                        time, where = 0, []
                        for j, p, q in elements(b, x, y):
                            if j == CUE_TIME:
                                time = uint(b, p, q)
                            elif j == CUE_WHERE:
                                found = {k: uint(b, u, v) for k, u, v in elements(b, p, q)}
                                where.append((found.get(CUE_TRACK, 0), origin + found.get(CUE_CLUSTER, 0)))
                        cues += [(time * scale / 1e6, track, position) for track, position in where]
    return File(tracks, packets, cues, clusters, duration * scale / 1e6)


# ---- writing ------------------------------------------------------------------------------


def size_of(n: int) -> bytes:
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return (n | 1 << (7 * k)).to_bytes(k, "big")


def element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(content)) + content


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def difference(d: int) -> bytes:
    """A signed step of an EBML lace."""
    k = 1
    while not -((1 << (7 * k - 1)) - 1) <= d <= (1 << (7 * k - 1)) - 1:
        k += 1
    return ((d + (1 << (7 * k - 1)) - 1) | 1 << (7 * k)).to_bytes(k, "big")


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    steps = b"".join(difference(b - a) for a, b in zip(sizes[:-2], sizes[1:-1]))
    return 3, head + size_of(sizes[0]) + steps + b"".join(frames)


HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(EBML_ID_MAX, 4) + number(EBML_SIZE_MAX, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
TRACK_TABLE = element(
    TRACKS,
    element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + number(FRAME_NS, UNIT * 1_000_000_000 // RATE_HZ) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))),
)


def write(payload: bytes) -> bytes:
    """A file whose one track holds ``payload`` as 8-bit samples."""
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE_HZ)) + element(MUXER, b"forgeframe") + element(WRITER, b"forgeframe"))
    parts, cues, at = [info, TRACK_TABLE], [], len(info) + len(TRACK_TABLE)
    per_block = UNIT * FRAMES
    for c in range(0, len(payload), per_block * BLOCKS):
        time = c * 1000 // RATE_HZ
        inside = [number(TIMESTAMP, time)]
        for o in range(c, min(len(payload), c + per_block * BLOCKS), per_block):
            data = payload[o : min(o + per_block, len(payload))]
            kind, body = lace([data[i : i + UNIT] for i in range(0, len(data), UNIT)])
            inside.append(element(SIMPLE, b"\x81" + struct.pack(">hB", o * 1000 // RATE_HZ - time, 0x80 | kind << 1) + body))
        cluster = element(CLUSTER, b"".join(inside))
        cues.append(element(CUE, number(CUE_TIME, time) + element(CUE_WHERE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# ---- columns ------------------------------------------------------------------------------


def packets(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, track, timestamp_ms, offset, size, key_frame, cluster, lacing, error): a row for each packet of binary ``content``."""

    def make():
        def block(columns):
            rows = []
            for k, b in zip(*columns):
                try:
                    rows += [(k, *p, None) for p in (parse(b).packets if b is not None else [])]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((k, *[None] * 7, str(e) or "broken"))
            return [list(x) for x in zip(*rows)] if rows else [[] for _ in range(9)]

        return block

    return map_rows(files.select(key, content), f"`{key}` {dict(files.dtypes)[key]}, track bigint, timestamp_ms double, offset bigint, size bigint, key_frame boolean, cluster bigint, lacing int, error string", make)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text's padded UTF-8 bytes as a Matroska file."""

    def make():
        return lambda columns: [columns[0], [write(padded((t or "").encode())) for t in columns[1]]]

    return map_rows(docs.select(key, text), f"`{key}` {dict(docs.dtypes)[key]}, media binary", make)


def padded(b: bytes, unit: int = 64) -> bytes:
    return b + bytes(-len(b) % unit if b else unit)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and returns digests and features of what was read."""

    def features(b: bytes) -> tuple:
        media = write(padded(b))
        found = parse(media)
        read = b"".join([media[p.offset : p.offset + p.size] for p in found.packets])
        track = found.tracks[0]
        text = f"{track['codec']} {track['rate']:.0f}Hz {track['depth']}bit packets={len(found.packets)} clusters={len(found.clusters)} cues={len(found.cues)} ms={found.duration_ms:.0f} last={found.packets[-1].timestamp_ms:.0f} mean={sum(read) // len(read)}"
        return len(b), len(read), sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), sha256(media).hexdigest(), text

    def make():
        return lambda columns: [columns[0], *([list(x) for x in zip(*[features((t or "").encode()) for t in columns[1]])] or [[] for _ in range(7)])]

    return map_rows(docs.select(key, text), f"`{key}` {dict(docs.dtypes)[key]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", make)
