"""Layout and structure queries over page lines (as text items) and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.operators import layout as L
from lectorium.operators.versions import latest
from lectorium.plans.library import _BLK, blocks
from lectorium.plans.registry import query
from lectorium.sources.tables import table

_IT = (
    "WITH it AS (SELECT paper_id doc_id, page, line_id item_ix, text, x_left x, y_top y, width, height, coalesce(font_size, height * 0.9) font_size FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY ingested_at DESC) k FROM page_lines) WHERE k = 1), "
    "pg AS (SELECT DISTINCT doc_id, page FROM it) "
)


def items(spark, root):
    d = table(spark, root, "page_lines", "line_id", "paper_id", "page", "text", "x_left", "y_top", "width", "height", "font_size", "ingested_at")
    d = latest(d, ["line_id"], ["ingested_at"])
    return d.select(F.col("paper_id").alias("doc_id"), "page", F.col("line_id").alias("item_ix"), "text", F.col("x_left").alias("x"), F.col("y_top").alias("y"), "width", "height", F.coalesce("font_size", F.col("height") * 0.9).alias("font_size"))


def pages(it):
    return it.select("doc_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})


@query("lay_01_median", _IT + "SELECT doc_id, round(coalesce(median(font_size), 0), 6)::DOUBLE font FROM it GROUP BY 1")
def _(spark, root):
    return items(spark, root).groupBy("doc_id").agg(F.round(L.median("font_size"), 6).alias("font"))


@query(
    "lay_02_union_box",
    _IT + "SELECT doc_id, page, round(min(x), 4) x, round(min(y), 4) y, round(max(x + width) - min(x), 4) width, round(greatest(max(y + height) - min(y), 1.0), 4) height FROM it GROUP BY 1, 2",
)
def _(spark, root):
    b = L.union_box(items(spark, root), "doc_id", "page")
    return b.select("doc_id", "page", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


@query("lay_03_columns")
def _(spark, root):
    it = items(spark, root)
    return L.page_columns(it, pages(it))


@query(
    "lay_04_peaks",
    _IT + ", h AS (SELECT doc_id, floor(width / 8 + 0.5) * 8 bin, count(*) n, min(item_ix) seen FROM it GROUP BY 1, 2), f AS (SELECT doc_id, first(bin ORDER BY n DESC, seen) b, max(n) n FROM h GROUP BY 1), "
    "s AS (SELECT h.doc_id, f.b, f.n fn, first(h.bin ORDER BY h.n DESC, h.seen) sb, max(h.n) sn FROM h JOIN f USING (doc_id) WHERE abs(h.bin - f.b) >= 40 GROUP BY 1, 2, 3) "
    "SELECT doc_id, least(b, sb)::DOUBLE left_x, greatest(b, sb)::DOUBLE right_x FROM s WHERE sn >= greatest(4, fn * 0.2)",
)
def _(spark, root):
    return L.two_peaks(items(spark, root).withColumn("sep", F.lit(40.0)), ["doc_id"], "width", "sep")


@query("lay_07_lines")
def _(spark, root):
    it = items(spark, root)
    return L.line_frame(L.lines_of(L.with_column(it, L.page_columns(it, pages(it))).select(*it.columns, "column")))


@query("lay_11_reading_order")
def _(spark, root):
    it = items(spark, root)
    lines = L.with_column(it, L.page_columns(it, pages(it))).select("doc_id", "page", "column", F.col("item_ix").alias("line_ix"), F.col("y").alias("line_y"), "x")
    return L.in_reading_order(lines).select("doc_id", "page", "line_ix", "column", "place")


@query(
    "lay_09_chrome",
    _IT + ", e AS (SELECT DISTINCT doc_id, page, regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS key FROM it WHERE y < 63.36 OR y > 792 - 55.44), "
    "n AS (SELECT doc_id, count(*) n_all FROM pg GROUP BY 1) SELECT doc_id, key, count(*) n_pages FROM e JOIN n USING (doc_id) WHERE length(key) BETWEEN 4 AND 140 GROUP BY doc_id, key, n_all HAVING count(*) >= greatest(2, floor(n_all * 0.28))",
)
def _(spark, root):
    it = items(spark, root)
    return L.repeated_chrome(it, pages(it))


_TWO = (
    "WITH b AS (SELECT paper_id, page_start page, block_id, block_order, bbox.x_left x, bbox.y_top y, bbox.width width, bbox.height height, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at DESC) k FROM layout_blocks), bl AS (SELECT * FROM b WHERE k = 1), "
    "l0 AS (SELECT paper_id, page, line_id, text, x_left x, y_top y, width, height, row_number() OVER (PARTITION BY line_id ORDER BY ingested_at DESC) k FROM page_lines), li AS (SELECT * FROM l0 WHERE k = 1) "
)


def boxes(spark, root):
    b = blocks(spark, root, "page_start", "block_order", "bbox")
    return b.select("paper_id", F.col("page_start").alias("page"), "block_id", "block_order", F.col("bbox.x_left").alias("x"), F.col("bbox.y_top").alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"))


def lines(spark, root):
    return items(spark, root).withColumnRenamed("doc_id", "paper_id")


@query(
    "lay_19_best_region",
    _TWO + ", o AS (SELECT li.paper_id, li.page, line_id rect_id, block_id region_id, greatest(0, least(li.x + li.width, bl.x + bl.width) - greatest(li.x, bl.x)) * greatest(0, least(li.y + li.height, bl.y + bl.height) - greatest(li.y, bl.y)) area, "
    "pow(li.x + li.width / 2 - bl.x - bl.width / 2, 2) + pow(li.y + li.height / 2 - bl.y - bl.height / 2, 2) far FROM li JOIN bl ON li.paper_id = bl.paper_id AND li.page = bl.page) "
    "SELECT paper_id, page, rect_id, first(region_id ORDER BY area DESC, far, region_id) region_id, round(max(area), 4) area FROM o WHERE area > 0 GROUP BY 1, 2, 3",
)
def _(spark, root):
    r = L.best_region(lines(spark, root).withColumnRenamed("item_ix", "rect_id"), boxes(spark, root).withColumnRenamed("block_id", "region_id"), ["paper_id", "page"])
    return r.withColumn("area", F.round("area", 4))


@query(
    "lay_20_text_in_boxes",
    _TWO + ", h AS (SELECT bl.paper_id, bl.page, block_id, string_agg(li.text, ' ' ORDER BY li.y, li.x, line_id) t, count(*) n FROM bl JOIN li ON li.paper_id = bl.paper_id AND li.page = bl.page AND li.x + li.width / 2 BETWEEN bl.x AND bl.x + bl.width AND li.y + li.height / 2 BETWEEN bl.y AND bl.y + bl.height GROUP BY 1, 2, 3) "
    "SELECT bl.paper_id, bl.page, bl.block_id box_id, coalesce(t, '') AS text, coalesce(n, 0) n FROM bl LEFT JOIN h USING (paper_id, page, block_id)",
)
def _(spark, root):
    return L.text_in_boxes(lines(spark, root), boxes(spark, root).withColumnRenamed("block_id", "box_id"), ["paper_id", "page"])


@query(
    "lay_21_nearest_block",
    _TWO + ", d AS (SELECT li.paper_id, li.page, line_id span_id, block_id, block_order, pow(greatest(bl.x - li.x, li.x - bl.x - bl.width, 0), 2) + pow(greatest(bl.y - li.y, li.y - bl.y - bl.height, 0), 2) d FROM li JOIN bl ON li.paper_id = bl.paper_id AND li.page = bl.page) "
    "SELECT paper_id, page, span_id, first(block_id ORDER BY d, block_order, block_id) block_id, round(min(d), 4) d2 FROM d GROUP BY 1, 2, 3",
)
def _(spark, root):
    n = L.nearest_block(lines(spark, root).withColumnRenamed("item_ix", "span_id"), boxes(spark, root), ["paper_id", "page"])
    return n.withColumn("d2", F.round("d2", 4))


@query(
    "str_01_page_class",
    _IT + "SELECT doc_id, page, CASE WHEN count(*) < 10 OR sum(length(text)) < 40 THEN 'scanned' WHEN sum(length(text) - length(replace(text, chr(65533), ''))) >= sum(length(text)) * 0.04 OR count(*) FILTER (regexp_matches(text, '(\\p{L} ){4,}\\p{L}')) >= 3 THEN 'garbled' ELSE 'native' END kind FROM it GROUP BY 1, 2",
)
def _(spark, root):
    return L.page_class(items(spark, root)).select("doc_id", "page", "kind")


@query(
    "str_02_document_class",
    _IT + ", k AS (SELECT doc_id, CASE WHEN count(*) < 10 OR sum(length(text)) < 40 THEN 'scanned' WHEN count(*) FILTER (regexp_matches(text, '(\\p{L} ){4,}\\p{L}')) >= 3 THEN 'garbled' ELSE 'native' END kind FROM it GROUP BY doc_id, page) "
    "SELECT doc_id, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END kind FROM k GROUP BY 1",
)
def _(spark, root):
    return L.document_class(L.page_class(items(spark, root)))


@query(
    "str_04_spacing",
    _IT + ", w AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, item_ix) py, lag(height) OVER (PARTITION BY doc_id, page ORDER BY y, item_ix) ph FROM it) SELECT doc_id, page, round(median(y - py - ph), 6)::DOUBLE gap, round(avg(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)), 6) upper_share FROM w GROUP BY 1, 2",
)
def _(spark, root):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("y", "item_ix")
    d = items(spark, root).withColumn("gap", F.col("y") - F.lag("y").over(w) - F.lag("height").over(w))
    upper = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    return d.groupBy("doc_id", "page").agg(F.round(F.median("gap"), 6).alias("gap"), F.round(F.avg(upper), 6).alias("upper_share"))


@query(
    "str_14_under_heading",
    _BLK + "SELECT paper_id, block_id, last_value(CASE WHEN block_role = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY block_order, block_id ROWS UNBOUNDED PRECEDING) section FROM blk",
)
def _(spark, root):
    return L.under_heading(blocks(spark, root, "block_order", "block_role", "text")).select("paper_id", "block_id", "section")


@query("str_15_reading_edges", _BLK + "SELECT * FROM (SELECT paper_id, block_id source, lead(block_id) OVER (PARTITION BY paper_id ORDER BY block_order, block_id) target FROM blk) WHERE target IS NOT NULL")
def _(spark, root):
    return L.reading_edges(blocks(spark, root, "block_order"))


@query(
    "str_16_heading_parents",
    _BLK + ", h AS (SELECT paper_id, block_id, block_order, regexp_extract(text, '^\\s*(\\d+(\\.\\d+)*)\\s', 1) num FROM blk WHERE block_role = 'heading'), a AS (SELECT *, regexp_extract(num, '^(.*)\\.\\d+$', 1) parent FROM h WHERE num <> '') "
    "SELECT a.paper_id, a.block_id source, arg_max(b.block_id, (b.block_order, b.block_id)) target FROM a JOIN h b ON a.paper_id = b.paper_id AND a.parent = b.num AND b.block_order < a.block_order WHERE a.parent <> '' GROUP BY 1, 2",
)
def _(spark, root):
    return L.heading_parents(blocks(spark, root, "block_order", "block_role", "text"))


@query("str_18_captions")
def _(spark, root):
    b = blocks(spark, root, "page_start", "block_order", "block_role", "bbox")
    p = b.select("paper_id", F.col("page_start").alias("page"), F.col("block_id").alias("id"), F.col("block_order").alias("ord"), F.col("bbox.x_left").alias("x"), F.col("bbox.y_top").alias("y"), "block_role")
    return L.captions_to_figures(p.where("block_role = 'caption'").drop("block_role"), p.where("block_role = 'figure'").drop("block_role"))
