"""Page layout: columns, lines, reading order, furniture, boxes.

Text items are one frame: doc_id, page, item_ix, text, x, y, width, height, font_size; pages: doc_id, page,
width, height (the page's).  Statistics of a page are conditional aggregates; only what depends on the
visiting order (running line medians) runs as a grouped Arrow function per page.
"""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.operators.ordered import with_carried, with_next

# Thresholds of column detection, in page units or shares of the page width.
HEADER_Y, FOOTER_MARGIN, MIN_COLUMN_ITEMS, SPAN_SHARE, BIN = 52.0, 48.0, 8, 0.55, 8


def median(c: Column | str) -> Column:
    """Median, mean of the middle two for even counts; 0 for none."""
    return F.coalesce(F.median(c), F.lit(0.0))


def union_box(items: DataFrame, *keys: str) -> DataFrame:
    """Box around all items of a key; at least one unit high."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    x, y = F.min("x"), F.min("y")
    return items.groupBy(*keys).agg(x.alias("x"), y.alias("y"), (right - x).alias("width"), F.greatest(bottom - y, F.lit(1.0)).alias("height"))


def two_peaks(sample: DataFrame, keys: list[str], x: str, separation: str) -> DataFrame:
    """The two most frequent x bins that lie at least ``separation`` apart; ties go to the bin seen first.

    The second must hold 4 items and a fifth of the first.  Gives keys, left_x, right_x.
    """
    binned = sample.withColumn("bin", F.floor(F.col(x) / BIN + 0.5) * BIN)
    h = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("item_ix").alias("seen"), F.first(separation).alias("sep"))
    first = h.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "seen", "bin")).alias("f"))
    far = h.join(first, keys).where(F.abs(F.col("bin") - F.col("f.bin")) >= F.col("sep"))
    second = far.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "seen", "bin")).alias("s"), F.first("f").alias("f"))
    ok = second.where(-F.col("s.m") >= F.greatest(F.lit(4.0), -F.col("f.m") * 0.2))
    return ok.select(*keys, F.least("f.bin", "s.bin").cast("double").alias("left_x"), F.greatest("f.bin", "s.bin").cast("double").alias("right_x"))


def page_columns(items: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per page: multi_column, gutter_x, left_x, right_x."""
    k = ["doc_id", "page"]
    p = pages.select(*k, F.col("width").alias("pw"), F.col("height").alias("ph"))
    u = items.join(p, k).where((F.col("y") >= HEADER_Y) & (F.col("y") <= F.col("ph") - FOOTER_MARGIN))
    long_ = F.col("width").between(F.col("pw") * 0.25, F.col("pw") * 0.55)
    u = u.withColumn("n_long", F.count_if(long_).over(Window.partitionBy(*k)))
    sample = u.where(F.when(F.col("n_long") >= 8, long_).otherwise(F.col("width") < F.col("pw") * SPAN_SHARE))
    sample = sample.withColumn("n_sample", F.count("*").over(Window.partitionBy(*k))).where(F.col("n_sample") >= 2 * MIN_COLUMN_ITEMS).withColumn("sep", F.col("pw") * 0.18)
    peaks = two_peaks(sample, k, "x", "sep")
    s = sample.join(peaks, k)
    is_left = F.abs(F.col("x") - F.col("left_x")) <= F.abs(F.col("x") - F.col("right_x"))
    mid = F.col("width").between(F.col("pw") * 0.22, F.col("pw") * 0.55)
    g = s.groupBy(*k, "pw", "left_x", "right_x").agg(
        F.count_if(is_left).alias("l"), F.count_if(~is_left).alias("r"), F.count_if(is_left & mid).alias("ll"), F.count_if(~is_left & mid).alias("rl"),
        F.count("*").alias("n"), F.median(F.when(long_, F.col("width"))).alias("wide"),
    )
    share = F.col("l") / F.col("n")
    enough = (F.least("l", "r", "ll", "rl") >= MIN_COLUMN_ITEMS) & (F.col("right_x") - F.col("left_x") >= F.col("pw") * 0.22) & share.between(0.22, 0.78)
    width = F.coalesce(F.when(F.col("wide") != 0, F.col("wide")), (F.col("right_x") - F.col("left_x")) * 0.8)
    found = g.where(enough).select(*k, F.lit(True).alias("multi_column"), ((F.col("left_x") + width + F.col("right_x")) / 2).alias("gutter_x"), "left_x", "right_x")
    d = p.join(found, k, "left")
    return d.select(
        *k, F.coalesce("multi_column", F.lit(False)).alias("multi_column"), F.coalesce("gutter_x", F.col("pw") / 2).alias("gutter_x"),
        F.coalesce("left_x", F.lit(0.0)).alias("left_x"), F.coalesce("right_x", F.col("pw") / 2).alias("right_x"), F.col("pw").alias("page_width"), F.col("ph").alias("page_height"),
    )


def with_column(items: DataFrame, layouts: DataFrame) -> DataFrame:
    """Append ``column``: single, spanning, left or right."""
    d = items.join(layouts, ["doc_id", "page"])
    wide = (F.col("width") > F.col("page_width") * SPAN_SHARE) | ((F.col("width") > F.col("page_width") * 0.4) & (F.col("x") < F.col("gutter_x") - 20) & (F.col("x") + F.col("width") > F.col("right_x") + 20))
    c = F.when(~F.col("multi_column"), "single").when(wide, "spanning").when(F.col("x") + F.col("width") / 2 < F.col("gutter_x"), "left").otherwise("right")
    return d.withColumn("column", c)


def joined_text(items: DataFrame, *keys: str) -> DataFrame:
    """Items of a key joined left to right; a blank where the gap is wider than a seventh of the type size."""
    w = Window.partitionBy(*keys).orderBy("x", "y", "item_ix")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    blank = (gap > F.greatest(F.lit(1.1), F.lag("font_size").over(w) * 0.14)) & ~F.lag("text").over(w).rlike(r"\s$") & ~F.col("text").rlike(r"^\s")
    d = items.withColumns({"_t": F.concat(F.when(blank, " ").otherwise(""), "text"), "_k": F.row_number().over(w)})
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda s: s["_t"]), "")
    return d.groupBy(*keys).agg(F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"))


def lines_of(items: DataFrame) -> DataFrame:
    """Append ``line_ix``: items of one column clustered by height to the nearest running line median.

    Body items open and join lines in reading order; raised and lowered items join the nearest line.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        base = f.font_size.median() or 10.0
        reach = max(3.2, base * 0.42)
        body = f.font_size >= base * 0.82
        order = f[body if body.any() else body | True].sort_values(["y", "x", "item_ix"]).index
        ys: list[list[float]] = []
        place: dict[int, int] = {}
        for i in order:
            y = f.at[i, "y"]
            near = [(abs(statistics.median(g) - y), k) for k, g in enumerate(ys[-4:], max(0, len(ys) - 4))]
            d, k = min(near, default=(reach + 1, -1))
            if d > reach:
                ys.append([])
                k = len(ys) - 1
            ys[k].append(y)
            place[i] = k
        mids = [statistics.median(g) for g in ys]
        for i in f.index.difference(order):
            y = f.at[i, "y"]
            place[i] = min(range(len(mids)), key=lambda k: (abs(mids[k] - y), k))
        rank = {k: n for n, k in enumerate(sorted(range(len(mids)), key=lambda k: mids[k]))}
        return f.assign(line_ix=[rank[place[i]] for i in f.index])

    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*items.schema.fields, StructField("line_ix", IntegerType())])
    return items.groupBy("doc_id", "page", "column").applyInPandas(run, schema)


def line_frame(items: DataFrame) -> DataFrame:
    """Lines with text, box, median height of their body items and mean type size."""
    keys = ["doc_id", "page", "column", "line_ix"]
    w = Window.partitionBy(*keys)
    d = items.withColumn("_mean", F.avg("font_size").over(w))
    body = F.col("font_size") >= F.col("_mean") * 0.82
    stats = d.groupBy(*keys).agg(F.coalesce(F.median(F.when(body, F.col("y"))), F.median("y")).alias("line_y"), F.avg("font_size").alias("line_font"))
    return joined_text(items, *keys).join(stats, keys).join(union_box(items, *keys), keys)


def in_reading_order(lines: DataFrame) -> DataFrame:
    """Append ``place`` on the page: spanning lines above the columns, then bands between mid-page spanning
    lines (left column before right), then spanning lines below.

    Every line has exactly one place: a line right above a cut stays in the band it lies in, and a spanning
    line is placed once.
    """
    k = ["doc_id", "page"]
    w = Window.partitionBy(*k)
    in_col = F.col("column").isin("left", "right")
    d = lines.withColumns({"_top": F.min(F.when(in_col, F.col("line_y"))).over(w), "_bottom": F.max(F.when(in_col, F.col("line_y"))).over(w)})
    span = F.col("column") == "spanning"
    zone = F.when(span & (F.col("line_y") < F.col("_top") - 6), 0).when(span & (F.col("line_y") > F.col("_bottom") + 6), 2).otherwise(1)
    d = d.withColumn("_zone", zone)
    cut = span & (F.col("_zone") == 1)
    up = Window.partitionBy(*k).orderBy("line_y").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_band", F.when(F.col("_zone") == 1, F.coalesce(F.sum(F.when(cut, 1).otherwise(0)).over(up), F.lit(0))).otherwise(0))
    rank = F.when(F.col("column").isin("left", "single"), 0).when(F.col("column") == "right", 1).otherwise(2)
    o = Window.partitionBy(*k).orderBy("_zone", "_band", rank, "line_y", "x", "line_ix")
    return d.withColumn("place", F.row_number().over(o)).drop("_top", "_bottom", "_zone", "_band")


def chrome_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\d+", "#"), r"\s+", " ")


def repeated_chrome(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Keys (digits masked) that stand in the edge bands of many pages of a document: doc_id, key, n_pages."""
    p = pages.select("doc_id", "page", F.col("height").alias("ph"))
    top, bottom = F.greatest(F.lit(HEADER_Y), F.col("ph") * 0.08), F.greatest(F.lit(FOOTER_MARGIN), F.col("ph") * 0.07)
    edge = items.join(p, ["doc_id", "page"]).where((F.col("y") < top) | (F.col("y") > F.col("ph") - bottom))
    keys = edge.select("doc_id", "page", chrome_key(F.col("text")).alias("key")).where(F.length("key").between(4, 140)).distinct()
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_all"))
    g = keys.groupBy("doc_id", "key").agg(F.count("*").alias("n_pages")).join(n, "doc_id")
    return g.where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("n_all") * 0.28))).select("doc_id", "key", "n_pages")


def overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def best_region(rects: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each rectangle with the region of its page it overlaps most; ties by distance of centres, then id.

    rects: keys, rect_id, x, y, width, height; regions: keys, region_id and a box.
    """
    r = regions.select(*keys, "region_id", *[F.col(c).alias(f"r{c}") for c in ("x", "y", "width", "height")])
    d = rects.join(r, keys)
    area = overlap(*[F.col(c) for c in ("x", "y", "width", "height", "rx", "ry", "rwidth", "rheight")])
    far = (F.col("x") + F.col("width") / 2 - F.col("rx") - F.col("rwidth") / 2) ** 2 + (F.col("y") + F.col("height") / 2 - F.col("ry") - F.col("rheight") / 2) ** 2
    d = d.withColumns({"area": area, "far": far}).where("area > 0")
    return d.groupBy(*keys, "rect_id").agg(F.min(F.struct((-F.col("area")).alias("m"), "far", "region_id")).alias("b")).select(*keys, "rect_id", F.col("b.region_id").alias("region_id"), (-F.col("b.m")).alias("area"))


def text_in_boxes(items: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Each box with the text of the items whose centre lies in it, by height and x; empty boxes stay."""
    b = boxes.select(*keys, "box_id", *[F.col(c).alias(f"b{c}") for c in ("x", "y", "width", "height")])
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = cx.between(F.col("bx"), F.col("bx") + F.col("bwidth")) & cy.between(F.col("by"), F.col("by") + F.col("bheight"))
    hit = items.join(b, keys).where(inside)
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "item_ix", "text"))), lambda s: s["text"]), " ")
    return boxes.select(*keys, "box_id").join(hit.groupBy(*keys, "box_id").agg(t.alias("text"), F.count("*").alias("n")), [*keys, "box_id"], "left").fillna({"text": "", "n": 0})


def nearest_block(spans: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The block of the page that lies nearest to each span (box distance, then block order)."""
    b = blocks.select(*keys, "block_id", "block_order", *[F.col(c).alias(f"b{c}") for c in ("x", "y", "width", "height")])
    d = spans.join(b, keys)
    dx = F.greatest(F.col("bx") - F.col("x"), F.col("x") - F.col("bx") - F.col("bwidth"), F.lit(0.0))
    dy = F.greatest(F.col("by") - F.col("y"), F.col("y") - F.col("by") - F.col("bheight"), F.lit(0.0))
    best = F.min(F.struct((dx * dx + dy * dy).alias("d"), "block_order", "block_id")).alias("b")
    return d.groupBy(*keys, "span_id").agg(best).select(*keys, "span_id", F.col("b.block_id").alias("block_id"), F.col("b.d").alias("d2"))


def page_class(items: DataFrame) -> DataFrame:
    """scanned, garbled or native per page, from counts of items, replacement characters and spaced letters."""
    chars = F.sum(F.length("text"))
    bad = F.sum(F.regexp_count("text", F.lit("�")))
    spaced = F.count_if(F.col("text").rlike(r"(?:\p{L} ){4,}\p{L}"))
    g = items.groupBy("doc_id", "page").agg(F.count("*").alias("n_items"), chars.alias("n_chars"), bad.alias("n_bad"), spaced.alias("n_spaced"))
    kind = F.when((F.col("n_items") < 10) | (F.col("n_chars") < 40), "scanned").when((F.col("n_bad") >= F.col("n_chars") * 0.04) | (F.col("n_spaced") >= 3), "garbled").otherwise("native")
    return g.withColumn("kind", kind)


def document_class(page_kinds: DataFrame) -> DataFrame:
    """The kind of all pages, or mixed."""
    g = page_kinds.groupBy("doc_id").agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("k"))
    return g.select("doc_id", F.when(F.col("n") > 1, "mixed").otherwise(F.col("k")).alias("kind"))


def reading_edges(blocks: DataFrame, key: str = "block_id", doc: str = "paper_id", order: str = "block_order") -> DataFrame:
    """READS_BEFORE edges between neighbours in order."""
    d = with_next(blocks.select(doc, key, order), [doc], order, key, [key])
    return d.select(doc, F.col(key).alias("source"), F.col(f"next_{key}").alias("target")).where("target IS NOT NULL")


def under_heading(blocks: DataFrame, doc: str = "paper_id", order: str = "block_order", key: str = "block_id") -> DataFrame:
    """Each block with the heading it stands under, null before the first."""
    return with_carried(blocks, [doc], [order, key], F.when(F.col("block_role") == "heading", F.col("text")), "section")


def heading_parents(blocks: DataFrame) -> DataFrame:
    """CHILD_OF edges between numbered headings: the latest earlier heading of the parent number."""
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)\s", 1)
    h = blocks.where("block_role = 'heading'").select("paper_id", "block_id", "block_order", number.alias("num")).where("num <> ''")
    parent = F.regexp_extract("num", r"^(.*)\.\d+$", 1)
    a = h.withColumn("parent", parent).where("parent <> ''")
    b = h.select(F.col("paper_id"), F.col("num").alias("parent"), F.col("block_id").alias("target"), F.col("block_order").alias("at"))
    j = a.join(b, ["paper_id", "parent"]).where(F.col("at") < F.col("block_order"))
    return j.groupBy("paper_id", F.col("block_id").alias("source")).agg(F.max_by("target", F.struct("at", "target")).alias("target"))


def captions_to_figures(captions: DataFrame, figures: DataFrame) -> DataFrame:
    """CAPTION_OF: greedy one to one per page in caption order, by distance of boxes."""
    f = figures.select("paper_id", "page", F.col("id").alias("figure_id"), F.col("y").alias("fy"), F.col("x").alias("fx"))
    pairs = captions.join(f, ["paper_id", "page"]).withColumn("score", F.abs(F.col("y") - F.col("fy")) + F.abs(F.col("x") - F.col("fx")) * 0.5)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for cap, g in sorted(d.groupby("id"), key=lambda kv: (kv[1].ord.iloc[0], kv[0])):
            free = g[~g.figure_id.isin(taken)].sort_values(["score", "figure_id"])
            if len(free):
                taken.add(free.figure_id.iloc[0])
                out.append((free.paper_id.iloc[0], cap, free.figure_id.iloc[0]))
        return pd.DataFrame(out, columns=["paper_id", "source", "target"])

    return pairs.groupBy("paper_id", "page").applyInPandas(run, "paper_id string, source string, target string")
