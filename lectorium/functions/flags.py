"""Signs of a translation that went wrong, read from the whole text in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectorium.functions import facts

# Bounds from which a text counts as degenerate.
RUN, DOMINANT, FEW_KINDS = 8, (16, 0.4), (40, 0.08)
PHRASE, PHRASE_TIMES, PHRASE_SHARE, PHRASE_TEXT = 5, 3, 0.16, 36
SPLINTERS, SPLINTER_TEXT, SPLINTER_SHARE, BLANK_SHARE = 14, 40, 0.18, 0.12
LONG_SOURCE, BARE = 120, (4, 80)
_JA = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_BLANK = regex.compile(r"\s+")
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def signs(text: str) -> list[str]:
    """Names of all signs that hold, in a fixed order; the blank text has the sign ``empty`` alone."""
    solid = _BLANK.sub("", text)
    if not solid:
        return ["empty"]
    out = []
    if "�" in text or regex.search(r"<0x[0-9A-Fa-f]{2}>", text):
        out.append("bytes")
    if regex.search(r"[⟦⟧]|\bZ\d+Q\d*\b", text):
        out.append("placeholder")
    if regex.search(rf"(.)\1{{{RUN - 1}}}", solid):
        out.append("run")
    if regex.search(r"[\p{Thai}\p{Hangul}]", text):
        out.append("script")
    kinds = Counter(solid)
    if len(solid) >= DOMINANT[0] and max(kinds.values()) > DOMINANT[1] * len(solid):
        out.append("dominant")
    if len(solid) >= FEW_KINDS[0] and len(kinds) < FEW_KINDS[1] * len(solid):
        out.append("few_kinds")
    words = _NOT_WORD.sub("", text)
    if len(words) >= PHRASE_TEXT:
        most = max(Counter(words[i : i + PHRASE] for i in range(len(words) - PHRASE + 1)).values())
        if most >= PHRASE_TIMES and PHRASE * most >= PHRASE_SHARE * len(words):
            out.append("phrase")
    japanese = len(_JA.findall(text))
    splinters = sum(len(w) <= 2 and all(_JA.match(c) for c in w) for w in text.split())
    blanks = sum(map(str.isspace, text))
    if japanese >= SPLINTER_TEXT and splinters >= SPLINTERS and splinters > SPLINTER_SHARE * japanese and blanks > BLANK_SHARE * len(solid):
        out.append("splinters")
    return out


def signs_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else signs(x) for x in c], dtype=object)

    return run(text)


def foreign_share(source: str | None, output: str | None) -> float:
    """Share of Latin letters in an output, words of the source and figures aside; 0 for what is under eight signs."""
    known = {w.lower() for w in regex.findall(r"[A-Za-z]{2,}", source or "")}
    rest = output or ""
    if known:
        rest = regex.sub("|".join(regex.escape(w) for w in sorted(known, key=lambda w: (-len(w), w))), "", rest, flags=regex.I)
    rest = _BLANK.sub("", regex.sub(r"\d+(?:\.\d+)*", "", rest))
    return sum(c.isascii() and c.isalpha() for c in rest) / len(rest) if len(rest) >= 8 else 0.0


def foreign_share_column(source: Column, output: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([foreign_share(a, b) for a, b in zip(s, o)], dtype=float)

    return run(source, output)


def bare_facts(source: str | None, output: str | None) -> bool:
    """A sentence of the output consists of facts alone, without a Japanese word: what a lost clause leaves behind.
    Only outputs of several sentences for long sources are judged."""
    parts = [p for p in regex.split(r"(?<=[。！？!?])\s*", output or "") if p.strip()]
    if len((source or "").strip()) < LONG_SOURCE or len(parts) < 2:
        return False
    for p in parts:
        size = len(_BLANK.sub("", p))
        if BARE[0] <= size <= BARE[1] and any(kind in facts.STRUCTURED - {"url", "doi"} or kind == "acronym" for kind, _, _ in facts.invariants(p)):
            prose = regex.sub(r"\[[^\]]+\]|\([^)]*\)", "", p)
            if not _JA.search(prose):
                return True
    return False


def bare_facts_column(source: Column, output: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([bare_facts(a, b) for a, b in zip(s, o)], dtype=bool)

    return run(source, output)
