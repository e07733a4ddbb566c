"""One form for texts that look the same.

Method: the Arrow buffer of a batch is decoded once into an array of code points; a lookup table sends
each code point to an expansion (gather plus cumulative offsets), and marks are composed with their
bases by a vectorised search of sorted pairs.  No call is made per row.

What is folded
--------------
* full and half width; canonical equivalents (composed and combining, compatibility ideographs);
* letters of one shape from different scripts, to the Latin (or kana) letter;
* blanks of any width, each to one plain blank; the hyphens that differ only in breaking;
* invisible characters (format characters, fillers, variation selectors) vanish.
Kept apart: raised and lowered figures, other marks on a letter, other punctuation, letter case, line breaks.

Null texts stay null, empty texts stay empty.  The form of a form is the form itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Pairs of a letter and the letter of the same shape that stands for it.
SHAPES_CYRILLIC = "аa вB еe оo рp сc уy хx кk іi јj ѕs һh ԁd ԛq ԝw ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW ӀI ҮY"
SHAPES_GREEK = "οo αa ρp νv ιi κk υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϺM ͿJ"
SHAPES_LATIN = "ɑa ɡg ıi ʏY"
SHAPES_KANA = "へヘ タ夕 ト卜 ニ二 ロ口 ハ八 カ力 エ工 オ才 チ千 ム厶 ヒ匕 ー一"
# 'в' is small, 'κ' and 'к' are drawn like a small k, 'υ' like u.
SHAPES_NOT = "вB"
HYPHENS = "‐‑"
FILLERS = "ᅟᅠㅤﾠ឴឵͏"


def _shapes() -> dict[int, int]:
    out = {}
    for group in (SHAPES_CYRILLIC, SHAPES_GREEK, SHAPES_LATIN):
        for pair in group.split():
            if pair not in SHAPES_NOT.split():
                out[ord(pair[0])] = ord(pair[1])
    for pair in SHAPES_KANA.split():  # へ is written as the katakana, the kanji as the katakana
        a, b = pair
        if "぀" <= a <= "ゟ":
            out[ord(a)] = ord(b)
        else:
            out[ord(b)] = ord(a)
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start and length of each code point's expansion, the expansions, mark classes, pair keys, pair values."""
    shapes = _shapes()
    start = np.arange(sys.maxunicode + 1, dtype=np.int64)
    length = np.ones(sys.maxunicode + 1, dtype=np.int8)
    extra: list[int] = []
    ccc = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    pairs: dict[int, int] = {}
    base = sys.maxunicode + 1

    def expand(ch: str) -> list[int]:
        cat = unicodedata.category(ch)
        cp = ord(ch)
        if cat == "Cf" or ch in FILLERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            return []
        if cat == "Zs":
            return [0x20]
        if ch in HYPHENS:
            return [0x2D]
        raw = unicodedata.decomposition(ch)
        if raw.startswith(("<wide>", "<narrow>")):
            return [y for x in raw.split()[1:] for y in expand(chr(int(x, 16)))]
        out = [ord(x) for x in unicodedata.normalize("NFD", ch)]
        return [shapes.get(x, x) for x in out]

    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x4DBF or 0x20000 <= cp <= 0x2F7FF or 0x2FA20 <= cp <= 0xE0000 or 0xE01F0 <= cp:
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        seq = expand(ch)
        if seq != [cp]:
            start[cp], length[cp] = base + len(extra), len(seq)
            extra += seq
        raw = unicodedata.decomposition(ch)
        if raw and raw[0] != "<" and " " in raw and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in raw.split())
            pairs[shapes.get(a, a) << 32 | b] = cp  # a shape letter composes like the letter it stands for
            if a in shapes:
                pairs.setdefault(a << 32 | b, cp)
    for a, b in [(x, y) for x, y in shapes.items()]:  # a composed look-alike becomes the composed letter it looks like
        for mark in list({k & 0xFFFFFFFF for k in pairs if k >> 32 == b}):
            target = unicodedata.normalize("NFC", chr(b) + chr(mark))
            if len(target) == 1:
                pairs[b << 32 | mark] = ord(target)
    keys = np.array(sorted(pairs), dtype=np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
    gather = np.concatenate([np.arange(base, dtype=np.uint32), np.array(extra, dtype=np.uint32)])
    return start, length, gather, ccc, keys, values


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and the row offsets in code points; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts.take(pa.array(range(len(texts)), pa.int64()))])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1)
    if texts.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=int(ends[-1]))[int(ends[0]) :]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, lead[ends - ends[0]].astype(np.int64)


def fold(texts: pa.Array) -> pa.Array:
    """The one form of each text of a batch."""
    start, length, gather, ccc, keys, values = _tables()
    nulls = texts.is_null() if texts.null_count else None
    points, offs = _points(texts)
    sizes = length[points].astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(start[points] - (ends - sizes), sizes) + np.arange(total)
    out = gather[place].astype(np.int64)
    offs = np.concatenate([[0], ends])[offs]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    marks = ccc[out]
    if marks.any():
        while True:  # marks of one base in canonical order: adjacent swaps until none is out of order
            swap = np.flatnonzero((marks[1:] != 0) & (marks[:-1] > marks[1:]) & (row[1:] == row[:-1]))
            if not len(swap):
                break
            swap = swap[np.concatenate([[True], np.diff(swap) > 1])]
            out[swap], out[swap + 1] = out[swap + 1], out[swap]
            marks = ccc[out]
    while len(out) > 1:  # a mark joins the base right before it
        key = out[:-1] << 32 | out[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        a, b = out[:-1], out[1:]
        lv = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)  # Hangul joins by arithmetic
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b <= 0x11C2)
        known = (keys[at] == key) & (ccc[b] != 0)
        hit = np.flatnonzero((known | lv | lvt) & (row[:-1] == row[1:]))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        new = np.where(lv[hit], 0xAC00 + ((a[hit] - 0x1100) * 21 + b[hit] - 0x1161) * 28, np.where(lvt[hit], a[hit] + b[hit] - 0x11A7, values[at[hit]]))
        out[hit] = new
        keep = np.ones(len(out), bool)
        keep[hit + 1] = False
        out, row = out[keep], row[keep]
    counts = np.bincount(row, minlength=len(offs) - 1) if len(row) else np.zeros(len(offs) - 1, np.int64)
    data = out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    lead = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
    ends = lead[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    result = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).cast(pa.string())
    if nulls is not None:
        import pyarrow.compute as pc

        result = pc.if_else(nulls, pa.scalar(None, pa.string()), result)
    return result


def with_form(df, text: str, out: str = "form"):
    """Append the one form of column ``text``; all other columns stay as they are."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[f for f in df.schema.fields if f.name != out], StructField(out, StringType())])
    names = [f.name for f in schema.fields if f.name != out]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).select(names)
            yield from t.append_column(out, fold(b.column(b.schema.get_field_index(text)))).to_batches() or [pa.RecordBatch.from_pylist([], schema=t.schema.append(pa.field(out, pa.string())))]

    return df.mapInArrow(run, schema)


def same_look_pairs(df, table: str, row_id: str, key: str, text: str):
    """Pairs of rows of one ``key`` whose texts differ in characters but have one form.

    Rows without key or text are no cases.  Forms and texts travel as 128-bit digests, and the join is on
    (key, form), so its work is the classes themselves; a hot key is split by its forms, a hot form of one
    key by the engine's skew join.  Row ids must be unique (deliver through ``latest`` first).
    """
    from pyspark.sql import functions as F

    d = with_form(df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(row_id, key, text), text)
    d = d.select(F.col(row_id).alias("id"), F.col(key).alias("k"), F.md5("form").alias("form"), F.md5(text).alias("raw"))
    b = d.select(F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("form").alias("form2"), F.col("raw").alias("raw2"))
    on = (F.col("k") == F.col("k2")) & (F.col("form") == F.col("form2")) & (F.col("id") < F.col("id2")) & (F.col("raw") != F.col("raw2"))
    return d.join(b, on).select(F.lit(table).alias("src_table"), F.col("id").alias("id_a"), F.col("id2").alias("id_b"))


def same_look_classes(df, table: str, row_id: str, key: str, text: str):
    """Rows of one ``key`` that have one form, as classes: a row each, with the class (least id in it), the rows and
    the differing texts in it, and its links, the rows of the class whose text differs from its own.

    Classes of one row have no link and come too.  Counts are made by (key, form, text) first, so no class is held
    together, and a class of a third of all rows is no pair of anything."""
    from pyspark.sql import functions as F

    d = with_form(df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(row_id, key, text), text)
    d = d.select(F.col(row_id).alias("row_id"), F.col(key).cast("string").alias("k"), F.md5("form").alias("form"), F.md5(text).alias("raw"))
    same = d.groupBy("k", "form", "raw").agg(F.count("*").alias("n_same"), F.min("row_id").alias("least"))
    whole = same.groupBy("k", "form").agg(F.sum("n_same").alias("n_rows"), F.count("*").alias("n_texts"), F.min("least").alias("class_id"))
    sizes = same.join(whole, ["k", "form"]).select("k", "form", "raw", "class_id", "n_rows", "n_texts", (F.col("n_rows") - F.col("n_same")).alias("n_links"))
    return d.join(sizes, ["k", "form", "raw"]).select(F.lit(table).alias("src_table"), "row_id", "class_id", "n_rows", "n_texts", "n_links")
