"""String, encoding and hashing scalars with ASCII-only case rules."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistrata.functions.text import LOWER, UPPER, fold

#: Bytes that trimming removes at both ends: 0x07 to 0x0d and the blank.
TRIMMED = "\x07\x08\t\n\x0b\x0c\r "


def to_lower(s: Column) -> Column:
    return fold(s)


def to_upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def icmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes with A-Z lower-cased."""
    x, y = fold(a), fold(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def starts_with(s: Column, key: Column, ignore_case: bool = False) -> Column:
    return F.startswith(fold(s), fold(key)) if ignore_case else F.startswith(s, key)


def ends_with(s: Column, key: Column, ignore_case: bool = False) -> Column:
    return F.endswith(fold(s), fold(key)) if ignore_case else F.endswith(s, key)


def trim(s: Column) -> Column:
    return F.trim(s, F.lit(TRIMMED))


def squeeze(s: Column) -> Column:
    """Runs of characters 0x01 to 0x20 become their first one; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(s, "([\\x01-\\x20])[\\x01-\\x20]+", "$1"), "^[\\x01-\\x20]+|[\\x01-\\x20]+$", "")


def split(s: Column, delimiters: str) -> Column:
    """Fields between any of the delimiters; empty fields count, an empty text has none."""
    chars = "".join("\\" + c if c in "[]\\^-&" else c for c in delimiters)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"[{chars}]", -1))


def replace_map(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Left to right, the first key of the list that fits a place is replaced and what was put in is not looked at again.

    The text is cut into keys and what lies between by one alternation in the order of the list, then each cut is mapped."""
    import re

    keys = "|".join(re.escape(k) for k, _ in pairs)
    cuts = F.regexp_extract_all(s, F.lit(f"(?s){keys}|."), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for k, v in dict(reversed(pairs)).items() for x in (k, v)])  # of equal keys the first
    return F.array_join(F.transform(cuts, lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")


def base64_encode(s: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(s.cast("binary")), "[\\r\\n]", "")


def base64_decode(s: Column) -> Column:
    return F.unbase64(s)


def _bytes(s: Column) -> Column:
    """Two-digit upper-case hex of each byte of a text's UTF-8."""
    return F.regexp_extract_all(F.hex(F.encode(s, "utf-8")), F.lit(".."), F.lit(0))


#: Printable ASCII by its hex: what a byte-wise encoder leaves as it is.
def _plain(keep: str) -> Column:
    return F.create_map(*[F.lit(x) for c in keep for x in (f"{ord(c):02X}", c)])


def quoted_printable_encode(s: Column) -> Column:
    """`=XX` for `=`, for controls but tab, line feed and carriage return, and for bytes over 0x7e; no soft breaks."""
    plain = "\t\n\r" + "".join(chr(c) for c in range(0x20, 0x7F) if chr(c) != "=")
    known = _plain(plain)
    return F.array_join(F.transform(_bytes(s), lambda b: F.coalesce(F.try_element_at(known, b), F.concat(F.lit("="), b))), "")


def quoted_printable_decode(s: Column) -> Column:
    """The text (UTF-8) of `=XX` sequences and plain characters; soft line breaks go."""
    joined = F.regexp_replace(s, "=\\r?\\n", "")
    cuts = F.regexp_extract_all(joined, F.lit("(?s)=[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.decode(F.unhex(F.array_join(F.transform(cuts, lambda c: F.when(c.rlike("^=[0-9A-Fa-f]{2}$"), F.substring(c, 2, 2)).otherwise(F.hex(F.encode(c, "utf-8")))), "")), "utf-8")


def mime_word_encode(s: Column, kind: str = "B", charset: str = "UTF-8") -> Column:
    """`=?charset?B|Q?text?=`."""
    return F.concat(F.lit(f"=?{charset}?{kind}?"), base64_encode(s) if kind == "B" else quoted_printable_encode(s), F.lit("?="))


def mime_word_decode(s: Column) -> Column:
    kind, body = F.upper(F.regexp_extract(s, "^=\\?[^?]*\\?([BbQq])\\?", 1)), F.regexp_extract(s, "(?s)^=\\?[^?]*\\?[BbQq]\\?(.*)\\?=$", 1)
    return F.when(kind == "B", F.decode(F.unbase64(body), "utf-8")).when(kind == "Q", quoted_printable_decode(body)).otherwise(s)


def crc32(s: Column) -> Column:
    return F.crc32(s.cast("binary"))


def transcode(s: Column, charset: str = "ISO-8859-1") -> Column:
    """Through another character set and back; characters that it lacks become `?`."""
    return F.decode(F.encode(F.regexp_replace(s, "[^\\x00-\\xff]", "?"), charset), charset)


#: zlib's window bits by format.
_FORMATS = {"zlib": 15, "raw": -15, "gzip": 31}


def deflate(data: Column, kind: str = "zlib") -> Column:
    """The data compressed: with a zlib header, raw, or as gzip."""

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> bytes:
            c = zlib.compressobj(wbits=_FORMATS[kind])
            return c.compress(v) + c.flush()

        return pd.Series([None if v is None else one(bytes(v)) for v in values])

    return run(data.cast("binary"))


def inflate(data: Column, kind: str = "zlib") -> Column:
    """Compressed data as it was; null where it is broken."""

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> bytes | None:
            try:
                return zlib.decompress(v, _FORMATS[kind])
            except zlib.error:
                return None

        return pd.Series([None if v is None else one(bytes(v)) for v in values])

    return run(data.cast("binary"))
