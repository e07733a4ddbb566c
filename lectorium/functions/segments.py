"""Translation units: segmentation with protected spans, placeholders, and rejoining.

A unit's text is an exact slice of the source; joined without white space the units give the source back
(``round_trip``), which tests hold as a property on every row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectorium.functions import spans

#: What is never divided and reaches the engine under a placeholder.
PROTECTED = (spans.number_group, spans.inline_note, spans.author_year, spans.evidence, spans.url, spans.doi, spans.figure, spans.comparison, spans.measurement, spans.acronym)
OVERLONG, FEW_WORDS = 220, 4
# Abbreviations that end no unit.
ABBREVIATIONS = set("e.g i.e cf vs al fig figs eq dr prof mr mrs ms no vol pp p approx st ca bzw z.b d.h nr vgl abb tab".split())
_BULLET = re.compile(r"(?m)(?=^\s*[•・▪◦*-]\s+)")
_ENUMERATION = re.compile(r"(?=(?<![\w(])\(\d{1,2}\)\s+\S)")
_END = re.compile(r"[.!?。．！？]+[\"”’)\]」』]*(?=\s|$|(?<=[。．！？])|(?<=」))")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "」": "「", "』": "『"}


def protected(text: str) -> list[tuple[int, int]]:
    """Leftmost-longest spans that do not overlap."""
    return spans.longest(text, PROTECTED)


def masked(text: str) -> str:
    """Same length, protected spans filled: a scanner sees no mark inside them."""
    out = list(text)
    for a, b in protected(text):
        out[a:b] = "X" * (b - a)
    return "".join(out)


def _boundaries(text: str) -> list[int]:
    mask = masked(text)
    depth: list[str] = []
    at, cuts = 0, []
    for m in _END.finditer(mask):
        for c in mask[at : m.start()]:
            if c in _PAIRS.values():
                depth.append(c)
            elif c in _PAIRS and depth and depth[-1] == _PAIRS[c]:
                depth.pop()
        closes = sum(c in _PAIRS and c not in "”" or c == "”" for c in m.group())
        at = m.end()
        if len(depth) > closes:
            for c in m.group():
                if c in _PAIRS and depth and depth[-1] == _PAIRS[c]:
                    depth.pop()
            continue
        depth.clear()
        word = re.search(r"[\w.]*$", mask[: m.start()]).group().lower()
        nxt = mask[m.end() :].lstrip()[:1]
        if m.group() == "." and (word in ABBREVIATIONS or word.rpartition(".")[2] in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or nxt.islower()):
            continue
        cuts.append(m.end())
    return cuts


def _sliced(text: str, cuts: list[int]) -> list[str]:
    edges = [0, *sorted({c for c in cuts if 0 < c < len(text)}), len(text)]
    return [p for a, b in zip(edges, edges[1:]) if (p := text[a:b].strip())]


def _parted(unit: str) -> list[str]:
    """An overlong unit is divided at the semicolon nearest its middle, outside protected spans."""
    if len(unit) <= OVERLONG:
        return [unit]
    mask = masked(unit)
    depth, marks = 0, []
    for i, c in enumerate(mask):
        depth += (c in "([{“「") - (c in ")]}”」")
        if c in ";；" and depth <= 0 and 30 < i < len(unit) - 30:
            marks.append(i + 1)
    if not marks:
        return [unit]
    k = min(marks, key=lambda i: (abs(i - len(unit) / 2), i))
    return _parted(unit[:k].strip()) + _parted(unit[k:].strip())


def _merged(parts: list[str]) -> list[str]:
    """A fragment of fewer than four words without an end of its own joins the unit before."""
    out: list[str] = []
    for p in parts:
        latin = re.search(r"[A-Za-z]", p) and not re.search(r"[぀-ヿ一-鿿]", p)
        short = latin and len(p.split()) < FEW_WORDS and not re.search(r"[.!?]\W*$", p)
        if out and (short or re.fullmatch(r"\([^()]*\d{4}[a-z]?\)\.?", p)):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def units(text: str | None) -> list[str]:
    """Lists by item, inline enumerations by number, then sentences, overlong ones by clause."""
    if not text or not text.strip():
        return []
    items = [x for x in _BULLET.split(text) if x.strip()]
    if len(items) < 2 or len([x for x in items if re.match(r"\s*[•・▪◦*-]\s", x)]) < 2:
        items = [text]
    out = []
    for it in items:
        inline = _ENUMERATION.split(it)
        if len(inline) < 3:
            inline = [it]
        for x in inline:
            parts = _sliced(x, _boundaries(x))
            out += _merged([y for p in parts for y in _parted(p)])
    return out


def round_trip(text: str, parts: list[str]) -> bool:
    return re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(parts))


#: Nonces tried before a text is left to the engine as it is.
NONCES = 50


def shielded(text: str) -> tuple[str, list[str], str]:
    """Every protected span as a placeholder; the nonce occurs nowhere in the text."""
    nonce = next((x for x in (f"Z{k}Q" for k in range(NONCES)) if x not in text), None)
    if nonce is None:
        return text, [], ""
    out, kept, last = [], [], 0
    for a, b in protected(text):
        out += [text[last:a], f"⟦{nonce}{len(kept)}⟧"]
        kept.append(text[a:b])
        last = b
    return "".join(out) + text[last:], kept, nonce


_LOOKALIKE = str.maketrans("０１２３４５６７８９ＺＱｚｑ", "0123456789ZQzq")


def restored(text: str, kept: list[str], nonce: str) -> str:
    """Placeholders back to their spans, whatever brackets, width or case the engine gave them.

    A lost span goes before the last end mark, so the sentence keeps its end."""
    if not kept:
        return text
    seen: set[int] = set()

    def back(m: re.Match) -> str:
        k = int(m.group(1).translate(_LOOKALIKE))
        if k >= len(kept):
            return ""
        seen.add(k)
        return kept[k]

    wide = "".join(f"[{c}{chr(ord(c) + 0xFEE0)}]" for c in nonce)
    text = re.sub(r"[⟦\[［【]\s*" + wide + r"\s*([0-9０-９]+)\s*[⟧\]］】]", back, text, flags=re.I)
    lost = [s for k, s in enumerate(kept) if k not in seen]
    if not lost:
        return text
    end = re.search(r"[.!?。．！？]*\s*$", text)
    return text[: end.start()] + "".join(" " + s for s in lost) + end.group()


def joined(pieces: list[str], language: str) -> str:
    """Translated pieces in order: end marks put right, blanks only where the script uses them."""
    if language in ("ja", "zh"):
        out = ""
        for p in (x.strip() for x in pieces if x and x.strip()):
            if out and not re.search(r"[。．！？.!?」』)）\n]$", out):
                out += "。"
            out += p
        return out
    return " ".join(x.strip() for x in pieces if x and x.strip())


def degenerate(unit: str, source: str) -> bool:
    """Loops, leftovers of placeholders, or a length far below the source's."""
    if re.search(r"(\S)\1{7}|⟦|⟧|<0x", unit):
        return True
    words = unit.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    if len(grams) - len(set(grams)) >= 3:
        return True
    return len(source) >= 110 and len(source.split()) >= 18 and len(unit) < 0.28 * len(source)


def units_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else units(x) for x in c], dtype=object)

    return run(text)


def mock_engine(unit: str, source: str, target: str) -> str:
    """A deterministic engine for tests and dry runs: the unit in brackets of its language pair."""
    return f"[{source}>{target}] {unit}"


def translated(df, engine=mock_engine):
    """df: text, source_language, target_language and any keys.  Append ``output``, ``status``, ``error``.

    Units are translated alone; a unit that fails or degenerates falls back to its source slice, so one bad
    unit never loses a row.  The engine is loaded once per task.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    add = [StructField(c, StringType()) for c in ("output", "status", "error")]
    schema = StructType([*[f for f in df.schema.fields if f.name not in ("output", "status", "error")], *add])

    def run(frames):
        for f in frames:
            out = []
            for t, a, b in zip(f.text, f.source_language, f.target_language):
                pieces, bad = [], None
                for u in units(t):
                    hidden, kept, nonce = shielded(u)
                    try:
                        v = restored(engine(hidden, a, b), kept, nonce)
                        if degenerate(v, u):
                            raise ValueError("degenerate output")
                    except Exception as e:
                        v, bad = u, str(e)[:200]
                    pieces.append(v)
                out.append((joined(pieces, b or ""), "failed" if bad and len(pieces) == 1 else "partial" if bad else "completed", bad))
            d = f.drop(columns=[c for c in ("output", "status", "error") if c in f])
            yield d.assign(output=[x[0] for x in out], status=[x[1] for x in out], error=[x[2] for x in out])[[x.name for x in schema.fields]]

    return df.mapInPandas(run, schema)
