"""Charset detection and conversion to UTF-8 (X18), Arrow-batched where the native check for UTF-8 fails.

A byte-order mark decides; then valid UTF-8; then the escapes of ISO-2022. Of the other charsets those that
decode the bytes strictly are compared by how many of their characters are common in the languages that use
them; ties go to the earlier in ``CANDIDATES``. Bytes that no candidate fits are Latin-1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = [(b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]
ESCAPES = [(b"\x1b$B", "ISO-2022-JP"), (b"\x1b$@", "ISO-2022-JP"), (b"\x1b$)C", "ISO-2022-KR")]
#: Very common Chinese characters, simplified and traditional.
SIMPLIFIED = set("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里")
TRADITIONAL = set("的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡")
COMMON_CYRILLIC = set("оеаинтсрвлкмдпуяыьгзбч")
COMMON_LATIN = set("àâäçéèêëîïôöùûüßñáíóúãõåæøÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ’“”–€«»©®°£")


def kana(c: str) -> bool:
    return "\u3040" <= c <= "\u30ff"


def hangul(c: str) -> bool:
    return "\uac00" <= c <= "\ud7a3"


#: Charset, and which of its characters are what its languages mostly use.
CANDIDATES = [
    ("Shift_JIS", lambda c: kana(c)),
    ("EUC-JP", lambda c: kana(c)),
    ("EUC-KR", hangul),
    ("GB18030", SIMPLIFIED.__contains__),
    ("Big5", TRADITIONAL.__contains__),
    ("windows-1251", COMMON_CYRILLIC.__contains__),
    ("KOI8-R", COMMON_CYRILLIC.__contains__),
    ("windows-1252", COMMON_LATIN.__contains__),
]


def detect(b: bytes) -> str:
    """The charset of bytes; plain ASCII and the empty text are UTF-8."""
    for mark, name in MARKS:
        if b.startswith(mark):
            return name
    for escape, name in ESCAPES:
        if escape in b:
            return name
    try:
        b.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    best = ("ISO-8859-1", 0.0)
    for name, common in CANDIDATES:
        try:
            text = b.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in text if ord(c) > 127]
        share = sum(map(common, odd)) / max(1, len(odd))
        if share > best[1] + 1e-9:
            best = (name, share)
    return best[0]


def to_utf8(b: bytes, default: str = "") -> str:
    """The text of bytes by ``detect`` (``default``: the charset of what isn't UTF-8); what can't be decoded becomes U+FFFD."""
    name = detect(b)
    if default and name not in ("UTF-8", *(m for _, m in MARKS)):
        name = default
    text = b.decode(name, "replace")
    return text.removeprefix("\ufeff")


def _udf(f):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(bytes(v)) for v in values], dtype=object)

    return run


def plain(content: Column) -> Column:
    """Whether bytes are UTF-8 without a mark or escapes: those never reach Python."""
    return F.call_function("is_valid_utf8", content.cast("string")) & ~F.startswith(F.hex(content), F.lit("EFBBBF")) & ~content.cast("string").contains("\x1b")


def charset(content: Column) -> Column:
    return F.when(plain(content), "UTF-8").otherwise(_udf(detect)(F.when(~plain(content), content)))


def text_of(content: Column, default: str = "") -> Column:
    return F.when(plain(content), content.cast("string")).otherwise(_udf(lambda b: to_utf8(b, default))(F.when(~plain(content), content)))
