"""Noise in text from scanned pages: broken words, misread characters, running heads, page numbers.

Method: words are grouped by their confusable-glyph skeleton; in each group the frequent form that the
word before supports is taken as the right one.  Digits are masked to find heads and feet that return
on several pages of a paper; the place on the page (margin, off the grid of the body's lines) is a further sign.
Lines are put in reading order and joined with SQL windows.

Both tables become one frame of lines: a page line as it is, a block's text by its line breaks.

Defined results: lines are read once per key; null and blank texts are no lines; the last line of a page
continues in the first body line of the next page of its paper; a line that is furniture (head, foot,
page number) has no other kind and is skipped when its neighbours are joined.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.session import small, stored

#: Share of the page height (US letter, 792 units) that is margin above and below the body.
PAGE_HEIGHT, TOP, BOTTOM = 792.0, 0.0656, 0.942
#: A form is misread when the group's best form is so many times as frequent; odd signs inside need less.
RATIO, RATIO_ODD = 20.0, 2.0
#: Lines at the head and at the foot of a page that may be furniture, and the share of its pages on which a running head is one of them.
EDGE, EDGE_SHARE = 2, 0.8
#: A line is off the grid if its distance to the body differs by this part from the median distance of its page's lines.
OFF_GRID = 0.12
#: Suspect forms up to which they are broadcast (some 100 bytes each); more meet the words in a shuffle.
MOST_SUSPECTS = 200_000
# Glyphs that scans confuse, each class after its first sign.
CLASSES = ["l1!|iI", "oO0", "s5S", "eEcC", "tT†", "gG9", "bB6", "zZ2", "aA4", "ーー一", "著箸", "はは", "未末", "土士", "人入", "千干", "間問聞", "大太犬", "日目曰", "りリ", "ソン", "シツ", "ロ口", "ニ二", "カ力", "ヘへ", "エ工", "タ夕", "ト卜", "ハ八"]
# Sign pairs that are read for one sign.
DIGRAPHS = [("rn", "m"), ("vv", "w"), ("ll", "h"), ("el", "d")]
_MAP = {ord(c): k[0] for k in CLASSES for c in k[1:]}
_KANA_CONFUSABLE = {c for k in CLASSES[9:] for c in k}
_PAIR = regex.compile("[lI1]ま")
_WORD = regex.compile(r"[\p{Latin}\p{M}\p{N}†|!'’]*\p{Latin}[\p{Latin}\p{M}\p{N}†|!'’]*")
_EDGE = regex.compile(r"^[!|'’]+|[!|'’]+$")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]")
_HYPHEN_END = regex.compile(r"([\p{Latin}\p{M}\p{N}†|!]+)[-‐¬­]\s*$")
_FIRST = regex.compile(r"^[\p{Latin}\p{M}\p{N}†|!]+")
#: A line that could be a running head: capital first, no mark inside.
TITLE = r"^\p{Lu}[\p{L}\p{N}†!| '’-]+$|^\p{Lu}\p{L}+ et al\.$|^[\p{Lu}\p{N}][\p{L}\p{N}†!| .,()-]*(?i:vol)\. \S+ \(\S+\)$|^(\S ){5,}\S$|^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+$"
ROMAN = "^(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def skeleton(word: str) -> str:
    s = word.lower().translate(_MAP)
    for a, b in DIGRAPHS:
        s = s.replace(a, b)
    return s


def units(text: str, head: bool, tail: bool) -> list[tuple[str, str, str]]:
    """(skeleton, form, skeleton of the word before) of a line; head/tail: leave the first/last word out.

    In kana and kanji the unit is a confusable sign with two signs on either side.
    """
    out, last = [], ""
    found = list(_WORD.finditer(text))
    for i, m in enumerate(found):
        w = _EDGE.sub("", m.group()).lower()
        if not w or w.isdigit():
            continue
        s = skeleton(w)
        if not (head and i == 0 and m.start() == 0) and not (tail and i == len(found) - 1) and (len(w) > 1 or not w.isalpha()):
            out.append((s, w, last))
        last = s
    if _CJK.search(text):
        right = _PAIR.sub("\u0002は", text)  # a sign pair read for one sign: its place is kept
        plain, wrong = [], set()
        for c in right:
            if c == "\u0002":
                wrong.add(len(plain))
            else:
                plain.append(c)
        for i, c in enumerate(plain):
            if c in _KANA_CONFUSABLE:
                k = 1 if c == "は" else 2
                w = "".join(plain[max(0, i - k) : i + k + 1])
                if len(_CJK.findall(w)) >= 2 and not any(x.isdigit() or "a" <= x.lower() <= "z" for x in w):
                    out.append(("\u0001" + w.translate(_MAP), ("\u0002" if i in wrong else "") + w, ""))
    return out


def _line_frame(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """One frame of lines: src_table, row_key, origin, part (paper), page, ix, text, y, first and last page."""
    a = lines.select(
        F.lit("page_lines").alias("src_table"), F.col("line_id").cast("string").alias("row_key"), "origin", F.col("paper_id").alias("part"), F.lit("").alias("unit"),
        F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("ix"), "text", F.col("y_top").alias("y"), F.col("page").alias("from_page"), F.col("page").alias("to_page"),
    )
    b = blocks.select("paper_id", "block_id", "page_start", "page_end", F.posexplode(F.split("text", "\r?\n")).alias("ix", "text")).select(
        F.lit("layout_blocks").alias("src_table"), F.col("block_id").alias("row_key"), F.lit("ocr").alias("origin"), F.col("paper_id").alias("part"), F.col("block_id").alias("unit"),
        F.lit(0).cast("long").alias("page"), F.col("ix").cast("long").alias("ix"), "text", F.lit(None).cast("double").alias("y"), F.col("page_start").alias("from_page"), F.col("page_end").alias("to_page"),
    )
    return a.unionByName(b).where("trim(text) <> ''")


def masked(text: Column) -> Column:
    """Letters without their spacing and case, page and other free-standing numbers off, confusable signs to
    their class: the key of a running head."""
    t = F.when(text.rlike(r"(?<!\S)(?:\S ){4,}\S(?!\S)"), F.regexp_replace(text, r"(?<=(?:^|\s)\S) (?=\S(?:\s|$))", "")).otherwise(text)
    t = F.regexp_replace(t, r"^\W*(?=\S*[0-9])[0-9lIoO!|sS†]{1,5}\s+|\s+(?=\S*[0-9])[0-9lIoO!|sS†]{1,5}\W*$", "")
    t = F.regexp_replace(t, r"(?<![\p{L}0-9†!|])[0-9]+(?![\p{L}0-9†!|])", "")
    t = F.translate(F.lower(t), "".join(map(chr, _MAP)), "".join(_MAP.values()))
    for a, b in DIGRAPHS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\p{L}]", "")


def returning(d: DataFrame) -> DataFrame:
    """src_table, row_key of the page lines at an edge of their page whose masked text stands at the edge of
    several pages of the paper, seldom inside a page, and at least once apart from the body.

    Lines are reduced by paper, key and page before they are counted, so a hot paper is spread."""
    k = d.where("src_table = 'page_lines'").withColumn("_key", masked(F.col("text"))).where("length(_key) > 1").withColumn("_key", F.xxhash64("_key"))
    n = k.groupBy("part", "_key", "page").agg(F.max("_edge").alias("_edge"), F.max(F.col("_edge") & F.col("_apart")).alias("_apart"))
    n = n.groupBy("part", "_key").agg(F.count_if("_edge").alias("_e"), F.count("*").alias("_n"), F.max("_apart").alias("_apart"))
    n = n.where((F.col("_e") >= 2) & (F.col("_e") >= EDGE_SHARE * F.col("_n")) & F.col("_apart")).select("part", "_key")
    return k.where("_edge").join(n, ["part", "_key"], "left_semi").select("src_table", "row_key")


def with_furniture(d: DataFrame) -> DataFrame:
    """Append ``kind``: 'page_number', 'header' or null.

    A head of page lines returns over pages, or has a shape and a place of its own; no place alone makes one.
    """
    t = F.trim(F.col("text"))
    bare = F.lower(F.regexp_replace(t, r"(?i)^(page|seite|p\.|s\.|pp\.)\s*|^[\[(–—-]+\s*|\s*[\])–—-]+$|\.$", ""))
    first = F.regexp_extract(bare, r"^(\S+?)\s*(?:/\s*\S+)?$", 1)
    digits = F.translate(first, "lio|!s†g", "11011519")
    number = F.when(digits.rlike("^[0-9]{1,5}$"), digits.cast("int"))
    roman = first.rlike(ROMAN) & (F.length(first) <= 7)
    decorated = t.rlike(r"(?i)^(page|seite|p\.|s\.)\s*\S{1,5}$|^[–—-]\s*\S{1,5}\s*[–—-]$|^\[\S{1,5}\]$|^\S{1,5}\s*/\s*\S{1,5}$")
    near = number.between(F.col("from_page"), F.col("to_page"))
    shaped = number.isNotNull() | roman
    w = Window.partitionBy("src_table", "part", "unit", "page").orderBy("ix", "row_key")
    g = Window.partitionBy("src_table", "part", "unit", "page")
    plain = F.when(~F.coalesce(shaped, F.lit(False)), F.col("text"))  # neighbours that are no numbers alone
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumns({"_next": F.first(plain, ignorenulls=True).over(ahead), "_prev": F.lag("text").over(w), "_last": F.max("ix").over(g)})
    title = t.rlike(TITLE)
    # the width of the body: lines that could be heads have no say, nor has a single long one
    d = d.withColumn("_wide", F.max(F.when(~title & ~F.coalesce(shaped, F.lit(False)), F.length(t))).over(g))
    number_line = F.coalesce(shaped, F.lit(False)) & (decorated | near | (roman & ~t.rlike(r"^\d")) & (F.length(t) <= 5))
    fits = F.length(t) + 1 + F.length(F.regexp_extract("_next", r"^\s*(\S+)", 1)) <= F.col("_wide") - 1
    open_before = ~F.trim("_prev").rlike(r"[.!?。．！？]\W*$") | F.col("_prev").rlike(r"^\W*\S{1,8}\W*$")
    pair = t.rlike(r"^\p{Lu}[\p{L}\p{N}†!| -]* (?:and|AND) [\p{L}\p{N}†!| -]+$") & (F.col("ix") > 0) & F.coalesce(F.col("_next").rlike(r"^\s*[\p{Ll}\p{N}]"), F.lit(False))
    caps = (F.upper(t) == t) & t.rlike(r"\p{Lu}{3}")
    in_block = F.when(number_line & (F.col("_last") > 0), "page_number").when((F.col("_last") > 0) & (F.col("ix") < F.col("_last")) & title & ~t.rlike(r"[-‐¬\u00AD]$") & (fits | caps | pair & open_before), "header")
    # page lines: an edge line is apart if it is in the margin or off the grid of the body's lines
    up, down = F.col("y") - F.lag("y").over(w), F.lead("y").over(w) - F.col("y")
    d = d.withColumns({"_at": F.row_number().over(w), "_n": F.count("*").over(g), "_up": up, "_down": down}).withColumn("_pitch", F.percentile_approx("_down", 0.5).over(g))
    top = F.col("_at") <= EDGE
    edge = (F.col("src_table") == "page_lines") & (top | (F.col("_at") > F.col("_n") - EDGE))
    off = F.coalesce(F.abs(F.when(top, F.col("_down")).otherwise(F.col("_up")) / F.col("_pitch") - 1) > OFF_GRID, F.lit(False))
    margin = F.coalesce((F.col("y") < PAGE_HEIGHT * TOP) | (F.col("y") > PAGE_HEIGHT * BOTTOM), F.lit(False))
    outer = (F.col("_at") == 1) | (F.col("_at") == F.col("_n"))
    beside = F.coalesce(F.nullif(F.regexp_extract(t, r"^(\S{1,5})\s{2,}\S", 1), F.lit("")), F.regexp_extract(t, r"\S\s{2,}(\S{1,5})$", 1))
    beside = F.translate(F.lower(beside), "lio|!s†g", "11011519")
    numbered = F.when(beside.rlike("^[0-9]{1,5}$"), beside.cast("int")).between(F.col("from_page"), F.col("to_page")) & t.rlike(r"\p{L}")
    alone = F.when(shaped & (margin | edge & near & off), "page_number")
    alone = alone.when(F.coalesce(numbered & edge, F.lit(False)) | title & (margin | outer & off) | margin & off, "header")
    d = d.withColumns({"kind": F.when(F.col("src_table") == "page_lines", alone).otherwise(in_block), "_edge": edge, "_apart": margin | off})
    d = stored(d.drop("_next", "_prev", "_wide", "_last", "_at", "_n", "_up", "_down", "_pitch"))
    heads = stored(returning(d)).withColumn("_returns", F.lit(True))
    kind = F.coalesce("kind", F.when(F.col("_returns"), F.lit("header")))
    edges = d.where("_edge").join(heads, ["src_table", "row_key"], "left").withColumn("kind", kind).drop("_returns")
    return d.where("NOT _edge").unionByName(edges).drop("_edge", "_apart")


def with_next(body: DataFrame) -> DataFrame:
    """Append the key and text of the line that follows in reading order (``next_key``, ``next_text``) and
    the text before (``prev_text``); windows run over one page, pages of a paper over their first lines."""
    keys = ["src_table", "part", "unit", "page"]
    w = Window.partitionBy(*keys).orderBy("ix", "row_key")
    d = body.withColumns({"_n": F.lead(F.struct("row_key", "text")).over(w), "prev_text": F.lag("text").over(w), "_at": F.row_number().over(w)})
    ends = body.groupBy(*keys).agg(F.min_by(F.struct("row_key", "text"), F.struct("ix", "row_key")).alias("_first"), F.max_by("text", F.struct("ix", "row_key")).alias("_end"))
    p = Window.partitionBy("src_table", "part", "unit").orderBy("page")
    ends = ends.withColumns({"_over": F.lead("_first").over(p), "_before": F.lag("_end").over(p)}).select(*keys, "_over", "_before")
    d = d.join(ends, keys)
    n = F.coalesce("_n", "_over")
    return d.withColumns({"next_key": n["row_key"], "next_text": n["text"], "prev_text": F.when(F.col("_at") == 1, F.col("_before")).otherwise(F.col("prev_text"))}).drop("_n", "_over", "_before", "_at")


_UNITS = "src_table string, row_key string, next_key string, split int, skel string, form string, before string, hyphened string, ocr boolean"


def _emit(frames):
    for f in frames:
        rows = []
        for src, key, nk, origin, text, nxt, prev in zip(f.src_table, f.row_key, f.next_key, f.origin, f.text, f.next_text, f.prev_text):
            ocr = origin == "ocr"
            end = _HYPHEN_END.search(text)
            start = bool(prev and _HYPHEN_END.search(prev))
            for s, w, b in units(text, start, bool(end)):
                rows.append((src, key, None, 0, s, w, b, None, ocr))
            if end:
                part = _FIRST.match(nxt) if nxt else None
                a = end.group(1).lower()
                z = part.group().lower() if part else ""
                rows.append((src, key, nk if part else None, len(a), skeleton(a + z), a + z, "", a + "-" + z, ocr))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _UNITS.split(", ")])


_COMPOUND = r"[A-Za-zÀ-ÿ]{2,}-[A-Za-zÀ-ÿ]{2,}"


def analysed(lines: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """furniture, flow (body lines with their neighbours), hyphen (row keys) and fixes (row key, form, best)."""
    d = with_furniture(_line_frame(lines, blocks))
    body = d.where("kind IS NULL")
    flow = with_next(body.select("src_table", "part", "unit", "page", "ix", "row_key", "origin", "text"))
    u = stored(flow.select("src_table", "row_key", "next_key", "origin", "text", "next_text", "prev_text").mapInPandas(_emit, _UNITS))
    # frequencies of forms; broken words do not vote
    forms = u.where("hyphened IS NULL").groupBy("skel", "form").agg(F.count("*").alias("n"))
    best = F.max_by("form", F.struct("n", "form"))
    groups = forms.groupBy("skel").agg(best.alias("best"), F.max("n").alias("n_best"))
    # context: the same word before
    pairs = u.where("hyphened IS NULL AND before <> ''").groupBy("skel", "before", "form").agg(F.count("*").alias("n"))
    near = pairs.groupBy("skel", "before").agg(best.alias("best_here"))
    odd = F.col("form").rlike("\u0002") | F.col("form").rlike(r"[\p{L}].*[0-9†!|]|[0-9†!|].*\p{L}") & ~F.col("form").rlike(r"^[0-9]+\p{L}{0,2}$")
    suspect = forms.join(groups, "skel").where((F.col("form") != F.col("best")) & (F.col("n") * F.when(odd, RATIO_ODD).otherwise(RATIO) <= F.col("n_best")))
    # few and rare by their definition: up to MOST_SUSPECTS they go to the words, so frequent words do not move
    suspect = small(stored(suspect.select("skel", "form", "best", "n_best", "n", odd.alias("odd"))), MOST_SUSPECTS)
    plain = u.where("hyphened IS NULL AND ocr").join(suspect, ["skel", "form"]).join(near, ["skel", "before"], "left")
    misread = plain.where(F.col("odd") | F.col("best_here").isNull() | (F.col("best_here") != F.col("form")) | (F.col("n_best") >= 50 * F.col("n")))
    # a broken word: the joined form against the hyphened one; its wrong sign lies in one of the two lines
    broken = u.where("hyphened IS NOT NULL")
    compounds = body.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_COMPOUND})"))).alias("hyphened")).groupBy("hyphened").agg(F.count("*").alias("n_own"))
    whole = forms.groupBy("form").agg(F.sum("n").alias("n_whole"))
    b = broken.join(compounds, "hyphened", "left").join(whole, "form", "left").join(groups, "skel", "left").fillna(0, ["n_own", "n_whole"])
    hyphen = b.where("n_own <= n_whole OR n_own = 0").select("src_table", "row_key", "form")
    wrong = b.where((F.col("best") != F.col("form")) & F.col("ocr") & (F.col("n_whole") * RATIO_ODD <= F.col("n_best")) & (F.col("n_own") == 0))
    at = F.expr("coalesce(array_min(filter(sequence(1, length(form)), i -> substring(form, i, 1) <> substring(best, i, 1))), 0)")
    side = wrong.select("src_table", F.when(at > F.col("split"), F.coalesce("next_key", "row_key")).otherwise(F.col("row_key")).alias("row_key"), "form", "best")
    fixes = misread.select("src_table", "row_key", "form", "best").unionByName(side)
    return {"lines": d, "flow": flow, "hyphen": hyphen, "fixes": fixes}


def noise(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """src_table, row_key, noise_kind: one row per row and kind."""
    a = analysed(lines, blocks)
    furniture = a["lines"].where("kind IS NOT NULL").select("src_table", "row_key", F.col("kind").alias("noise_kind"))
    hyphen = a["hyphen"].select("src_table", "row_key", F.lit("hyphen").alias("noise_kind"))
    bad = a["fixes"].select("src_table", "row_key", F.lit("misread").alias("noise_kind"))
    return furniture.unionByName(hyphen).unionByName(bad).distinct()


def with_paragraph(flow: DataFrame) -> DataFrame:
    """Append ``para``: the number of the paragraph in its paper (a block is one).

    A new one starts at a heading or table cell, behind one, and behind a short line that ends a sentence.
    Numbers run within a page; pages of a paper add the sum of those before, so no task holds a paper's lines.
    """
    keys = ["src_table", "part", "unit", "page"]
    t, prev = F.trim("text"), F.trim("prev_text")
    wide = F.max(F.length("text")).over(Window.partitionBy(*keys))
    alone = lambda c: (F.length(c) < 40) & ~c.rlike(r"[.!?。．！？,;、，-]\W*$") & c.rlike(r"^[\p{Lu}\p{N}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]") & (F.size(F.split(c, " ")) <= 4)
    ended = prev.rlike(r"[.!?。．！？][\"”’)\]」』]*$") & ~prev.rlike(r"(?:\b(?:cf|vs|e\.g|i\.e|al|Fig|Tab|Dr|No|vgl|bzw|ca|approx|Abb|Nr|S|p|\p{Lu}))\.$") & (F.length(prev) < 0.85 * wide)
    new = F.when(F.col("unit") != "", F.lit(False)).otherwise(F.col("prev_text").isNull() | alone(prev) & (F.length(prev) < 0.6 * wide) | ended | (alone(t) & (F.length(t) < 0.6 * wide) & prev.rlike(r"[.!?。．！？]\W*$")))
    w = Window.partitionBy(*keys).orderBy("ix", "row_key")
    d = flow.withColumn("_n", F.coalesce(new, F.lit(False)).cast("int")).withColumn("_in", F.sum("_n").over(w))
    p = Window.partitionBy("src_table", "part", "unit").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = d.groupBy(*keys).agg(F.sum("_n").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(p), F.lit(0))).drop("_s")
    return d.join(pages, keys).withColumn("para", F.col("_off") + F.col("_in")).drop("_n", "_in", "_off")


def _reflowed(pieces: list[tuple[str, bool]], fixes: dict[str, str]) -> str:
    """Lines of one paragraph to running text; fixes keep the letter case of what they replace."""
    out = ""
    japanese = any("\u3040" <= c <= "\u30ff" for text, _ in pieces for c in text)
    for text, broken in pieces:
        t = text.strip()
        latin = out[-1:].isascii() and out[-1:].isalpha() and t[:1].isascii() and t[:1].isalpha()
        glue = "" if not out or out.endswith("\u0003") or (japanese and not latin) else " "
        if regex.search(r"\p{L}[-‐¬­]$", out):  # a word's own hyphen
            out, glue = out[:-1] + "-", ""
        out = out.rstrip("\u0003") + glue + (regex.sub(r"[-‐¬­]\s*$", "", t) + "\u0003" if broken else t)
    out = out.rstrip("\u0003")
    for form, best in fixes.items():
        if form.startswith("\u0002"):
            out = out.replace(best.replace("は", "lま"), best)
        elif _CJK.search(form):
            out = out.replace(form, best)
    if fixes:

        def put(m):
            b = fixes.get(_EDGE.sub("", m.group()).lower())
            if b is None:
                return m.group()
            tail = m.group()[len(m.group().rstrip("!|'’")) :]
            b = b.upper() if len(b) > 1 and m.group().isupper() else b[:1].upper() + b[1:] if m.group()[:1].isupper() else b
            return b + tail

        out = _WORD.sub(put, out)
    return out


def paragraphs(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Clean paragraphs in reading order: src_table, paper_id, unit (block id or ''), para, page, n_lines, text."""
    a = analysed(lines, blocks)
    f = with_paragraph(a["flow"])
    broken = a["hyphen"].select("src_table", "row_key", F.lit(True).alias("_b")).where("src_table = 'page_lines'").distinct()
    words = a["hyphen"].where("src_table = 'layout_blocks'").groupBy("src_table", "row_key").agg(F.collect_set("form").alias("_words"))
    f = f.join(broken, ["src_table", "row_key"], "left").join(words, ["src_table", "row_key"], "left")
    # a block's key covers its lines: a line is broken if the joined form is one of the block's
    joined = F.lower(F.concat(F.regexp_extract("text", r"([\p{L}\p{M}\p{N}†|!]+)[-‐¬\u00AD]\s*$", 1), F.regexp_extract("next_text", r"^([\p{L}\p{M}\p{N}†|!]+)", 1)))
    f = f.withColumn("_b", F.coalesce("_b", F.array_contains("_words", joined), F.lit(False)))
    keys = ["src_table", "part", "unit", "para"]
    fixes = f.select(*keys, "row_key").join(a["fixes"], ["src_table", "row_key"]).select(*keys, "form", "best").distinct()
    fixes = fixes.groupBy(*keys).agg(F.collect_list(F.struct("form", "best")).alias("fixes"))
    g = f.groupBy(*keys).agg(F.min("page").alias("page"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("page", "ix", "row_key", "text", "_b"))).alias("pieces"))
    g = g.join(fixes, keys, "left").select(*keys, "page", "n_lines", F.transform("pieces", lambda x: x["text"]).alias("texts"), F.transform("pieces", lambda x: x["_b"]).alias("broken"), "fixes")

    def run(frames):
        for x in frames:
            text = [_reflowed(list(zip(t, b)), {r["form"]: r["best"] for r in (q if q is not None else ())}) for t, b, q in zip(x.texts, x.broken, x.fixes)]
            yield pd.DataFrame({"src_table": x.src_table, "paper_id": x.part, "unit": x.unit, "para": x.para, "page": x.page, "n_lines": x.n_lines, "text": text})

    return g.mapInPandas(run, "src_table string, paper_id string, unit string, para long, page long, n_lines long, text string")
