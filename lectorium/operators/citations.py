"""Citations, glossary, annotation anchors, highlight segments."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.functions import spans

MOST_WIDE = 20
#: Roles of blocks that may be reference entries.
REFERENCE_ROLES = ("reference", "paragraph")


def citation_groups(text: str | None) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers) of each bracketed group; a range opens if it is at most ``MOST_WIDE`` wide."""
    out = []
    for a, b in spans.found(text or "", spans.number_group):
        keys: dict[int, None] = {}
        for item in text[a + 1 : b - 1].replace("–", "-").replace("—", "-").split(","):
            low, _, high = item.partition("-")
            first, last = int(low), int(high or low)
            if not high:
                keys[first] = None
            elif 0 < first <= last <= first + MOST_WIDE:
                keys |= dict.fromkeys(range(first, last + 1))
        if keys:
            out.append((a, b, list(keys)))
    return out


def citation_groups_column(text: Column) -> Column:
    """Groups of a text with their places (0-based code points)."""

    @F.pandas_udf("array<struct<start:int,stop:int,keys:array<int>>>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else citation_groups(x) for x in c], dtype=object)

    return run(text)


def citation_keys(text: Column) -> Column:
    """Distinct numbers of all groups in order; null for null."""
    return F.array_distinct(F.flatten(F.transform(citation_groups_column(text), lambda g: g["keys"])))


def reference_key(text: Column) -> Column:
    """The number an entry of a reference list bears: in square brackets, or with a full stop before a capital."""
    head = F.regexp_extract(F.trim(text), r"^(\[[0-9]+\]|[0-9]+\.(?=\s+[A-Z]))", 1)
    return F.nullif(F.regexp_replace(head, "[^0-9]", ""), F.lit(""))


def unique_references(blocks: DataFrame, doc: str, key: str, role: str | None = None) -> DataFrame:
    """Reference numbers that exactly one block of the document carries.  With ``role`` only blocks of
    ``REFERENCE_ROLES`` count, so a numbered heading is no reference."""
    d = blocks if role is None else blocks.where(F.col(role).isin(*REFERENCE_ROLES))
    d = d.withColumn("num", reference_key(F.col("text"))).where("num IS NOT NULL")
    return d.groupBy(doc, "num").agg(F.count("*").alias("n"), F.min(key).alias("target")).where("n = 1").select(doc, "num", "target")


def resolved(citing: DataFrame, references: DataFrame, doc: str) -> DataFrame:
    """Single-number citations with their target block; others have none."""
    d = citing.withColumn("keys", citation_keys(F.col("text")))
    d = d.withColumn("num", F.when(F.size("keys") == 1, F.element_at("keys", 1).cast("string")))
    return d.join(references, [doc, "num"], "left")


_LINK_END = frozenset("<>\"'）)")


def _address(t: str, i: int) -> int | None:
    """A web address up to a blank, bracket, quotation mark or angle; end marks are not part of it."""
    j = next((i + len(x) for x in ("https://", "http://") if t[i : i + len(x)].lower() == x), None)
    k = j
    while k is not None and k < len(t) and not t[k].isspace() and t[k] not in _LINK_END:
        k += 1
    return k if k != j else None


def links(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, href) of addresses and, outside of them, DOIs, in order; end marks are off."""
    t, out, taken = text or "", [], []
    for grammar, head in ((_address, ""), (spans.doi, "https://doi.org/")):
        for a, b in spans.found(t, grammar):
            value = t[a:b].rstrip(".,;:")
            if head and t[:a].lower().rstrip().endswith("doi:"):
                a = t[:a].lower().rindex("doi:")
            if not any(a < y and x < b for x, y in taken):
                end = a + len(t[a:b].rstrip(".,;:"))
                taken.append((a, end))
                out.append((a, end, head + value))
    return sorted(out)


def links_column(text: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,stop:int,href:string>>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else links(x) for x in c], dtype=object)

    return run(text)


def linked(text: Column, targets: Column) -> Column:
    """Single numbers in square brackets that have a target become links, unless they are links already.
    targets: map of number to block, of numbers that only one reference bears."""
    nums = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\](?!\()"), 1))
    known = F.filter(nums, lambda n: F.map_contains_key(targets, n))
    mark = lambda n, end: F.concat(F.lit("["), n, F.lit(end))
    link = lambda n: F.concat(mark(n, "](#"), F.element_at(targets, n), F.lit(")"))
    hidden = lambda t, n: F.replace(t, mark(n, "]("), mark(n, "\x01("))
    return F.aggregate(known, text, lambda t, n: F.replace(F.replace(hidden(t, n), mark(n, "]"), link(n)), mark(n, "\x01("), mark(n, "](")))


#: Signs before a bracketed term that its translation takes the place of.
LEAD = 40


class Glossary:
    """Terms in a tree of letters; a text is read once, whatever the number of terms."""

    def __init__(self, entries: tuple[tuple[str, str], ...]):
        self.tree: dict = {}
        for term, translation in entries:
            node = self.tree
            for c in term.lower():
                node = node.setdefault(c, {})
            node.setdefault("", (term, translation))

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, term, translation) of every place of every term, words whole."""
        low, out = text.lower(), []
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        part = lambda c: c == "_" or c.isascii() and c.isalnum()
        for i in range(len(low)):
            if i and part(low[i - 1]):
                continue
            node, k = self.tree, i
            while k < len(low) and low[k] in node:
                node, k = node[low[k]], k + 1
                if "" in node and not (k < len(low) and part(low[k])):
                    out.append((i, k, *node[""]))
        return out

    def apply(self, text: str) -> str:
        places = []
        for a, b, term, translation in sorted(self.found(text), key=lambda x: (x[0] - x[1], x[0])):  # longest first
            opened, closed = text[a - 1 : a] in ("(", "（") and a > 0, text[b : b + 1] in (")", "）") and b < len(text)
            if opened and closed:
                x = a - 1
                while x > 0 and a - 1 - x < LEAD and text[x - 1] not in "(（\n":
                    x -= 1
                a, b, translation = x, b + 1, f"{translation}（{term}）"
            elif opened or closed:
                continue
            if not any(a < y and x < b for x, y, _ in places):
                places.append((a, b, translation))
        for a, b, translation in sorted(places, reverse=True):
            text = text[:a] + translation + text[b:]
        return text


def with_glossary(text: str | None, entries: tuple[tuple[str, str], ...]) -> str | None:
    """Terms replaced by their translation, the longest of several at one place; a bracketed term takes the
    place of the words before it and keeps the original in brackets."""
    return _glossary(entries).apply(text) if text else text


@lru_cache(maxsize=8)
def _glossary(entries: tuple[tuple[str, str], ...]) -> Glossary:
    return Glossary(entries)


def glossary_column(text: Column, entries: tuple[tuple[str, str], ...]) -> Column:
    """entries: a glossary of bounded size, part of the plan.  Terms of one letter and empty translations have no say."""
    usable = tuple((term.strip(), tr.strip()) for term, tr in entries if tr.strip() and len(term.strip()) > 1)

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([with_glossary(x, usable) for x in c], dtype=object)

    return run(text)


def merged_glossaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """term, translation: b wins over a, case aside; a term keeps its first place (``ord``)."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    g = both.groupBy(F.lower(F.trim("term")).alias("k"))
    first = F.struct("_s", "ord")
    return g.agg(F.min(first).alias("_p"), F.max_by("term", first).alias("term"), F.max_by("translation", first).alias("translation")).select("term", "translation", F.col("_p._s").alias("side"), F.col("_p.ord").alias("ord"))


def reanchored(selected: str | None, start: int, prefix: str, suffix: str, text: str | None, unchanged: bool = False) -> tuple[int, str]:
    """Place of a selection in a changed text: (start, status).

    An unchanged text keeps the place; of several places the one whose surroundings share most signs with the
    stored context is taken, the first of equals; none, or a text or selection that is gone, makes an orphan."""
    if not text or not unchanged and not selected:
        return start, "orphaned"
    if unchanged:
        return start, "active"
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    best, at, where = -1, text.find(selected), None
    while at >= 0:
        before, behind = text[max(0, at - len(prefix)) : at], text[at + len(selected) :][: len(suffix)]
        near = shared(before[::-1], prefix[::-1]) + shared(behind, suffix)
        if near > best:
            best, where = near, at
        at = text.find(selected, at + 1)
    return (start, "orphaned") if where is None else (where, "active")


def reanchor_column(selected: Column, start: Column, prefix: Column, suffix: Column, text: Column, unchanged: Column | None = None) -> Column:
    @F.pandas_udf("struct<start:int,status:string>")
    def run(s: pd.Series, a: pd.Series, p: pd.Series, q: pd.Series, t: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = [reanchored(x, int(y) if y == y and y is not None else 0, z or "", w or "", v, bool(k)) for x, y, z, w, v, k in zip(s, a, p, q, t, u)]
        return pd.DataFrame(rows, columns=["start", "status"])

    return run(selected, start, prefix, suffix, text, F.lit(False) if unchanged is None else F.coalesce(unchanged, F.lit(False)))


def offsets_hold(text: Column, start: Column, end: Column, selected: Column) -> Column:
    return F.substring(text, start + 1, end - start) == selected


def highlight_segments(ranges: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """A text cut at all ends of its ranges: keys, seg_start, seg_end, ids (sorted, possibly none).

    ranges: keys, id, start, stop, and the text length.  An interval sweep: ends are exploded and the open
    ranges of each piece are found within the text's own ranges.
    """
    n = ranges.withColumn("_n", length)
    live = n.where("stop > start")
    clip = lambda c: F.greatest(F.lit(0), F.least(F.col("_n"), F.col(c))).cast("int")
    pts = live.select(*keys, F.explode(F.array(F.lit(0), F.col("_n").cast("int"), clip("start"), clip("stop"))).alias("p")).distinct()
    w = Window.partitionBy(*keys).orderBy("p")
    segs = pts.select(*keys, F.col("p").alias("seg_start"), F.lead("p").over(w).alias("seg_end")).where("seg_end IS NOT NULL")
    hit = segs.join(live.select(*keys, "id", "start", "stop"), keys).where((F.col("start") < F.col("seg_end")) & (F.col("stop") > F.col("seg_start")))
    ids = hit.groupBy(*keys, "seg_start", "seg_end").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return segs.join(ids, [*keys, "seg_start", "seg_end"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
