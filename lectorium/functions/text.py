"""Scalar text functions as column expressions, with the white space and rounding rules documents rely on."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space class of document text, byte order mark included.
SPACES = r"[\t\n\u000B\f\r    -     　﻿]"
KANA_HAN = r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]"


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return strip(F.regexp_replace(c, f"{SPACES}+", " "))


def normal_block_text(c: Column) -> Column:
    return F.lower(collapsed(c))


def filled(c: Column) -> Column:
    """Null for the empty string: what a truthiness test drops."""
    return F.when(c != "", c)


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    k = 10**digits
    return F.floor(c * k + 0.5) / k


def contains_folded(c: Column, needle: str) -> Column:
    n = needle.strip().lower()
    return F.lit(True) if not n else F.lower(c).contains(n)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def fnv1a(text: str) -> str:
    """32-bit FNV-1a over UTF-16 code units, eight hexadecimal digits."""
    h, raw = 0x811C9DC5, _units(text)
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def djb2(text: str) -> int:
    """Signed 32-bit xor variant of djb2 over UTF-16 code units of the first 120 characters."""
    h, raw = 5381, _units(text)[:240]
    for i in range(0, len(raw), 2):
        h = ((h * 33) & 0xFFFFFFFF) ^ (raw[i] | raw[i + 1] << 8)
    return h - (1 << 32) if h >= 1 << 31 else h


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in c], dtype=object)

    return run


def fnv1a_column(c: Column) -> Column:
    return _each(fnv1a, "string")(c)


def djb2_column(c: Column) -> Column:
    return _each(djb2, "int")(c)


def normalized(c: Column, form: str = "NFKC") -> Column:
    """Unicode normalisation in Arrow batches."""
    return _each(lambda x: unicodedata.normalize(form, x), "string")(c)


def half_width(c: Column) -> Column:
    """Full-width ASCII to half width, blanks after sentence marks put right."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)) + " "
    return F.translate(c, wide, plain)


def japanese_ratio(c: Column) -> Column:
    """Share of kana and kanji among the characters that are no white space; 0 for blank text."""
    solid = F.length(F.regexp_replace(c, f"{SPACES}+", ""))
    script = solid - F.length(F.regexp_replace(F.regexp_replace(c, f"{SPACES}+", ""), KANA_HAN, ""))
    return F.when(solid > 0, script / solid).otherwise(0.0)


def quantized(c: Column, step: int = 8) -> Column:
    return F.floor(c / step + 0.5).cast("long")


def block_id(kind: Column, page: Column, text: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Stable id of a block from type, page, normal text and quantized box."""
    box = F.concat_ws(",", *[quantized(v).cast("string") for v in (x, y, w, h)])
    return F.concat(F.lit("b-"), fnv1a_column(F.concat_ws("|", kind, page.cast("string"), normal_block_text(text), box)))
