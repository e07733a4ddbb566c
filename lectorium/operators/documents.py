"""Documents as a whole: memberships, translated share, titles, scans, lines of blocks, answers of a model."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.operators.ordered import with_carried
from lectorium.operators.versions import latest

#: Items of a page below which it needs recognition.
FEW_ITEMS = 10


def added(members: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New memberships that do not exist yet join; those that do are left as they are.  Of several new rows of a key
    the greatest in its other columns joins."""
    rest = [c for c in new.columns if c not in keys]
    once = latest(new, list(keys), rest) if rest else new.distinct()
    return members.unionByName(once.join(members.select(*keys), list(keys), "left_anti"))


def moved(members: DataFrame, moves: DataFrame, node: str, item: str) -> DataFrame:
    """Items go from one node to another in one step; an item that is already there only leaves the old one.

    moves: item, from_node, to_node (one row per item and node)."""
    m = moves.select(F.col(item), F.col("from_node").alias(node), F.col("to_node"))
    rest = members.join(m.select(item, node), [item, node], "left_anti").select(members.columns)
    gone = members.join(m, [item, node]).withColumn(node, F.col("to_node")).select(members.columns)
    return added(rest, gone, [node, item])


def translated_share(blocks: DataFrame, target: Column, done: Column, doc: str) -> DataFrame:
    """Percent of a document's targets that are done; a document without any target is at 100."""
    n = blocks.groupBy(doc).agg(F.count_if(target).alias("n_targets"), F.count_if(target & done).alias("n_done"))
    return n.withColumn("percent", F.when(F.col("n_targets") == 0, 100).otherwise(F.floor(100 * F.col("n_done") / F.col("n_targets") + 0.5)).cast("int"))


def scanned(items: DataFrame, doc: str, page: str) -> DataFrame:
    """Per document the items per page, whether it is a scan, and how many pages need recognition."""
    p = items.groupBy(doc, page).agg(F.count("*").alias("n"))
    d = p.groupBy(doc).agg(F.round(F.avg("n"), 6).alias("items_per_page"), F.count_if(F.col("n") < FEW_ITEMS).alias("pages_to_read"))
    return d.withColumn("is_scan", F.col("items_per_page") < FEW_ITEMS)


def titles(lines: DataFrame, doc: str, near: float = 0.5) -> DataFrame:
    """Title of a document: the lines of its first page in its largest font, in order.

    lines: doc, page, line_no, text, font_size.  A page's lines are few, so they are put together in one row."""
    d = lines.where("page = 1 AND font_size IS NOT NULL AND trim(text) <> ''")
    top = d.groupBy(doc).agg(F.max("font_size").alias("_top"))
    d = d.join(top, doc).where(F.col("font_size") >= F.col("_top") - near)
    g = d.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("text")))).alias("_l"))
    joined = F.aggregate(F.transform("_l", lambda x: x["text"]), F.lit(""), lambda a, x: F.when(a == "", x).when(a.rlike(r"\p{Ll}-$"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)))
    return g.select(doc, joined.alias("title"))


def attached(blocks: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Lines with the block of their page that has their text; of several blocks the last in order.

    blocks: doc, block_id, block_order, page, text; lines: doc, page, line_id, text."""
    key = F.regexp_replace(F.trim("text"), r"\s+", " ")
    b = blocks.where("trim(text) <> ''").select(doc, "page", "block_id", "block_order", F.explode(F.split("text", "\n")).alias("text"))
    b = b.withColumn("_key", key).where("_key <> ''").groupBy(doc, "page", "_key").agg(F.max_by("block_id", F.struct("block_order", "block_id")).alias("block_id"))
    return lines.withColumn("_key", key).join(b, [doc, "page", "_key"], "left").drop("_key")


_CJK_NAME = regex.compile(r"^[\p{Han}\p{Hiragana}\p{Katakana}ー々]+$")


def authors_of(line: str | None) -> list[str]:
    """Names of an author line: parted at commas, semicolons and the words for "and"; a run of single Japanese
    words is read as pairs of family and given name."""
    out: list[str] = []
    for part in regex.split(r"\s*[,;，；、・]\s*|\s+(?:and|und|&)\s+", regex.sub(r"[*†‡§¹²³⁴\d]+", "", line or "").strip()):
        words = part.split()
        if len(words) > 2 and all(_CJK_NAME.match(w) for w in words):
            out += [" ".join(words[i : i + 2]) for i in range(0, len(words), 2)]
        elif part.strip():
            out.append(" ".join(words))
    return out


def authors_column(line: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([authors_of(x) for x in c], dtype=object)

    return run(line)


def first_file(files: DataFrame, key: str, name: str, ending: str = ".pdf") -> DataFrame:
    """Of each key the first name with the ending, case aside."""
    return files.where(F.lower(name).endswith(ending)).groupBy(key).agg(F.min(name).alias(name))


def json_entries(answer: Column, schema: str) -> Column:
    """The first JSON array in a model's answer, as entries; null where there is none that can be read."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\[\s*\{.*?\}\s*\])", 1), schema)


def heading_number(text: Column) -> tuple[Column, Column]:
    """(number, rest) of a heading; the number is empty where there is none."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1)
    return number, F.when(number != "", F.regexp_replace(text, r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+", "")).otherwise(F.trim(text))


def repaired_input(text: Column) -> Column:
    """Slips that lead a translation engine astray: "its not" for "it is not", a comma before "nor"."""
    t = F.regexp_replace(text, r"\b([Ii])ts not\b", "$1t is not")
    return F.regexp_replace(t, r"\b([Nn]either [^,.;]+), nor\b", "$1 nor")


# The least ratio of a title's font to the body's, its least length, the edge of the page's head, and the
# bounds of a figure's crop (points, and share of the page's height).
TITLE_RATIO, TITLE_LENGTH, HEAD_EDGE, CROP_LEAST, CROP_MOST = 1.28, 8, 48.0, 36.0, 0.58
BODY_START = r"(?i)^\s*(?:[0-9]+\.?\s*)?(?:abstract|introduction|zusammenfassung|einleitung|要旨|概要|はじめに|序論)\s*$"


def first_page(lines: DataFrame, base: DataFrame, doc: str) -> DataFrame:
    """Per document the font of its title on the first page (0 where none stands out) and where its masthead ends.

    The masthead ends at the first heading that opens the body, else at the first long line in body font below the
    title, else nowhere (-1).  lines: doc, page, line_no, text, y, height, font_size; base: doc, body_font."""
    p = lines.where("page = 1 AND trim(text) <> ''").join(base, doc)
    font = p.groupBy(doc).agg(F.max(F.when(F.length(F.trim("text")) >= TITLE_LENGTH, F.col("font_size"))).alias("_max"), F.min(F.when(F.col("text").rlike(BODY_START), F.col("y"))).alias("_named"), F.first("body_font").alias("_base"))
    font = font.withColumn("title_font", F.when(F.col("_max") >= F.col("_base") * TITLE_RATIO, F.col("_max")).otherwise(0.0))
    p = p.join(font.select(doc, "title_font"), doc)
    title = (F.col("title_font") > 0) & (F.col("font_size") >= F.greatest(F.col("title_font") * 0.9, F.col("body_font") * TITLE_RATIO)) & F.length(F.trim("text")).between(TITLE_LENGTH, 180) & ~F.col("text").rlike(BODY_START)
    below = p.where(title).groupBy(doc).agg(F.min_by(F.col("y") + F.greatest(F.lit(18.0), F.col("height")), "line_no").alias("_below"))
    body = p.join(below, doc, "left").where((F.col("y") > F.coalesce("_below", F.lit(70.0))) & (F.col("font_size") <= F.col("body_font") * 1.08) & (F.length(F.trim("text")) > 50))
    body = body.groupBy(doc).agg(F.min_by("y", "line_no").alias("_body"))
    d = font.join(body, doc, "left")
    return d.select(doc, "title_font", F.coalesce("_named", "_body", F.lit(-1.0)).alias("masthead_end"))


def crops(blocks: DataFrame, doc: str, width: float = 612.0, height: float = 792.0, gutter: float = 306.0, left: float = 54.0) -> DataFrame:
    """The rectangle of the figure above each caption: down from the nearest block above in the caption's column.

    blocks: doc, block_id, role, page, side (left, right or full), x, y, w, h.  Blocks meet within their page; a
    rectangle lower than ``CROP_LEAST`` is none, a higher one than ``CROP_MOST`` of the page is cut at its top."""
    margin = max(left - 10, 18.0)
    side = F.col("side")
    band_x = F.when(side == "right", gutter + 8).otherwise(margin)
    band_w = F.when(side == "left", gutter - margin - 10).when(side == "right", width - gutter - 8 - 18).otherwise(width - margin - 18)
    c = blocks.where("role = 'caption'").select(doc, "page", "block_id", F.col("x").alias("_cx"), F.col("w").alias("_cw"), F.col("y").alias("_top"), band_x.alias("_bx"), band_w.alias("_bw"))
    o = blocks.where("role NOT IN ('figure', 'header', 'footer', 'copyright')").select(doc, "page", F.col("block_id").alias("_other"), F.col("x").alias("_x"), F.col("w").alias("_w"), (F.col("y") + F.col("h")).alias("_bottom"))
    above = c.join(o, [doc, "page"]).where("_other <> block_id AND _bottom <= _top - 2 AND _x < _bx + _bw AND _x + _w > _bx")
    bound = above.groupBy(doc, "block_id").agg(F.max("_bottom").alias("_bound"))
    d = c.join(bound, [doc, "block_id"], "left").withColumn("_bound", F.greatest(F.coalesce("_bound", F.lit(HEAD_EDGE)), F.lit(HEAD_EDGE)))
    tall = F.col("_top") - 3 - (F.col("_bound") + 3)
    d = d.withColumn("crop_h", F.least(tall, F.lit(height * CROP_MOST))).where(tall >= CROP_LEAST)
    x = F.greatest(F.lit(0.0), F.least("_bx", "_cx") - 6)
    right = F.least(F.lit(width), F.greatest(F.col("_bx") + F.col("_bw"), F.col("_cx") + F.col("_cw")) + 6)
    return d.select(doc, "block_id", "page", x.alias("crop_x"), (F.col("_top") - 3 - F.col("crop_h")).alias("crop_y"), F.greatest(F.lit(24.0), right - x).alias("crop_w"), "crop_h")


def reading_dump(blocks: DataFrame, doc: str) -> DataFrame:
    """A line for each block in reading order, with a mark where the page or the column changes.

    blocks: doc, block_id, block_order, page, side, text."""
    d = with_carried(blocks, [doc], ["block_order", "block_id"], F.struct("page", "side"), "_prev", own=False)
    mark = F.when(F.col("_prev").isNull() | (F.col("_prev.page") != F.col("page")), F.concat(F.lit("== page "), F.col("page").cast("string"), F.lit(" ==\n"))).when(F.col("_prev.side") != F.col("side"), F.concat(F.lit("-- "), "side", F.lit(" --\n"))).otherwise("")
    return d.select(doc, "block_id", F.concat(mark, F.coalesce("text", F.lit("[figure]"))).alias("line"))


def evidence(blocks: DataFrame, doc: str) -> DataFrame:
    """What a document shows of its kind: blocks by role, pages, and the DOIs it names."""
    dois = F.regexp_extract_all("text", F.lit(r"10\.[0-9]{4,9}/[0-9A-Za-z._;()/:-]+"), 0)
    n = blocks.groupBy(doc).agg(F.max("page").alias("n_pages"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("heading", "paragraph", "caption", "reference", "footnote", "list", "figure")])
    named = blocks.select(doc, F.explode(dois).alias("doi")).groupBy(doc).agg(F.countDistinct("doi").alias("n_dois"))
    return n.join(named, doc, "left").fillna(0, ["n_dois"])
