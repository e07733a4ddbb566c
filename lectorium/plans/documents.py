"""Queries on documents as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions import flags as X
from lectorium.functions import segments as G
from lectorium.operators import citations as C
from lectorium.operators import documents as D
from lectorium.operators import library as L
from lectorium.operators import merge as M
from lectorium.plans.library import _ANN, _BLK, _CUR, _RES, blocks, current, notes, results
from lectorium.plans.registry import query
from lectorium.sources.tables import table


def lines(spark, root, *cols):
    want = dict.fromkeys(["line_id", "ingested_at", *cols])
    return M.latest(table(spark, root, "page_lines", *want), ["line_id"], ["ingested_at"])


_LIN = "WITH lin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY ingested_at DESC) rn FROM page_lines) WHERE rn = 1) "


@query("lib_12_by_node", "SELECT DISTINCT node_id, lower(trim(paper_id)) paper_id, sort_order FROM workspace_papers WHERE node_id = 'n-0001' ORDER BY sort_order, paper_id")
def _(spark, root):
    w = table(spark, root, "workspace_papers", "node_id", "paper_id", "sort_order").withColumn("paper_id", F.lower(F.trim("paper_id")))
    return L.by_key(w, node_id="n-0001").distinct().orderBy("sort_order", "paper_id")


@query("lib_13_by_paper", "WITH " + _ANN + "SELECT id, block_id, created_at FROM ann WHERE paper_id = 'p-0000hotvol' ORDER BY created_at, id")
def _(spark, root):
    return L.by_key(notes(spark, root, "paper_id", "block_id", "created_at"), paper_id="p-0000hotvol").select("id", "block_id", "created_at").orderBy("created_at", "id")


@query("lib_13_by_block", "WITH " + _ANN + "SELECT a.id, paper_id, block_id FROM ann a WHERE (paper_id, block_id) IN (SELECT (paper_id, block_id) FROM ann GROUP BY paper_id, block_id HAVING count(*) > 1)")
def _(spark, root):
    a = notes(spark, root, "paper_id", "block_id")
    busy = a.groupBy("paper_id", "block_id").count().where("count > 1").select("paper_id", "block_id")
    return a.join(busy, ["paper_id", "block_id"], "left_semi").select("id", "paper_id", "block_id")


@query("lib_15_by_time", _RES + "SELECT result_id, task_id, model, completed_at FROM res WHERE model = 'kuroshio-3b' ORDER BY completed_at, result_id")
def _(spark, root):
    return L.by_key(results(spark, root, "task_id", "model", "completed_at"), model="kuroshio-3b").select("result_id", "task_id", "model", "completed_at").orderBy("completed_at", "result_id")


@query(
    "lib_23_translated_share",
    _BLK + ", " + _RES.replace("WITH ", "", 1) + ", done AS (SELECT DISTINCT paper_id, block_id FROM translation_tasks t JOIN res r USING (task_id) WHERE trim(r.text) <> ''), "
    "t AS (SELECT paper_id, block_role IN ('paragraph', 'heading', 'caption') AND trim(text) <> '' AS target, d.block_id IS NOT NULL AS done FROM blk LEFT JOIN done d USING (paper_id, block_id)) "
    "SELECT paper_id, count(*) FILTER (target) n_targets, count(*) FILTER (target AND done) n_done, (CASE WHEN count(*) FILTER (target) = 0 THEN 100 ELSE floor(100 * count(*) FILTER (target AND done) / count(*) FILTER (target) + 0.5) END)::INT percent FROM t GROUP BY 1",
)
def _(spark, root):
    r = results(spark, root, "task_id", "text").where("trim(text) <> ''").select("task_id")
    done = table(spark, root, "translation_tasks", "task_id", "paper_id", "block_id").join(r, "task_id", "left_semi").select("paper_id", "block_id").distinct().withColumn("done", F.lit(True))
    b = blocks(spark, root, "block_role", "text").join(done, ["paper_id", "block_id"], "left")
    target = F.col("block_role").isin("paragraph", "heading", "caption") & (F.trim("text") != "")
    return D.translated_share(b, target, F.col("done").isNotNull(), "paper_id")


@query(
    "str_03_scanned",
    _LIN + ", p AS (SELECT paper_id, page, count(*) n FROM lin GROUP BY 1, 2) SELECT paper_id, round(avg(n), 6) items_per_page, count(*) FILTER (n < 10) pages_to_read, round(avg(n), 6) < 10 AS is_scan FROM p GROUP BY 1",
)
def _(spark, root):
    return D.scanned(lines(spark, root, "paper_id", "page"), "paper_id", "page")


@query(
    "str_11_titles",
    _LIN + ", d AS (SELECT paper_id, line_no, line_id, trim(text) t, font_size, max(font_size) OVER (PARTITION BY paper_id) top FROM lin WHERE page = 1 AND font_size IS NOT NULL AND trim(text) <> '') "
    "SELECT paper_id, regexp_replace(string_agg(t, ' ' ORDER BY line_no, t), '(\\p{Ll})- ', '\\1', 'g') title FROM d WHERE font_size >= top - 0.5 GROUP BY 1",
)
def _(spark, root):
    return D.titles(lines(spark, root, "paper_id", "page", "line_no", "text", "font_size"), "paper_id")


@query("str_23_authors", _CUR + "SELECT id, unnest(authors) author FROM cur")
def _(spark, root):
    p = current(spark, root, "authors").select("id", F.array_join("authors", "; ").alias("line"))
    return p.select("id", F.explode(D.authors_column(F.col("line"))).alias("author"))


@query(
    "lay_22_attached",
    _LIN + ", " + _BLK.replace("WITH ", "", 1) + ", b AS (SELECT paper_id, page_start page, block_id, block_order, unnest(string_split(text, chr(10))) t FROM blk WHERE trim(text) <> ''), "
    "k AS (SELECT paper_id, page, regexp_replace(trim(t), '\\s+', ' ', 'g') k, arg_max(block_id, (block_order, block_id)) block_id FROM b GROUP BY 1, 2, 3 HAVING k <> '') "
    "SELECT line_id, k.block_id FROM lin LEFT JOIN k ON lin.paper_id = k.paper_id AND lin.page = k.page AND regexp_replace(trim(lin.text), '\\s+', ' ', 'g') = k.k",
)
def _(spark, root):
    b = blocks(spark, root, "block_order", "page_start", "text").withColumnRenamed("page_start", "page")
    return D.attached(b, lines(spark, root, "paper_id", "page", "text"), "paper_id").select("line_id", "block_id")


@query("hlp_12_first_file", _CUR + "SELECT source_file_hash, min(source_file_name) source_file_name FROM cur WHERE lower(source_file_name) LIKE '%.pdf' GROUP BY 1")
def _(spark, root):
    return D.first_file(current(spark, root, "source_file_hash", "source_file_name"), "source_file_hash", "source_file_name")


_MEM = "WITH mem AS (SELECT * FROM (SELECT node_id, lower(trim(paper_id)) paper_id, sort_order, row_number() OVER (PARTITION BY node_id, lower(trim(paper_id)) ORDER BY updated_at DESC, sort_order DESC) rn FROM workspace_papers) WHERE rn = 1) "


def members(spark, root):
    w = table(spark, root, "workspace_papers", "node_id", "paper_id", "sort_order", "updated_at").withColumn("paper_id", F.lower(F.trim("paper_id")))
    return M.latest(w, ["node_id", "paper_id"], ["updated_at", "sort_order"]).select("node_id", "paper_id", "sort_order")


@query(
    "tre_09_added",
    _MEM + ", new AS (SELECT 'inbox' node_id, id paper_id, 0 sort_order FROM papers GROUP BY id UNION ALL SELECT node_id, paper_id, 9 FROM mem) SELECT node_id, paper_id, sort_order FROM mem UNION ALL SELECT * FROM new n WHERE n.node_id = 'inbox'",
)
def _(spark, root):
    m = members(spark, root)
    new = table(spark, root, "papers", "id").distinct().select(F.lit("inbox").alias("node_id"), F.col("id").alias("paper_id"), F.lit(0).alias("sort_order"))
    return D.added(m, new.unionByName(m.withColumn("sort_order", F.lit(9))), ["node_id", "paper_id"])


@query(
    "tre_09_moved",
    _MEM + ", f AS (SELECT paper_id, min(node_id) a, max(node_id) b FROM mem GROUP BY 1 HAVING count(*) > 1) "
    "SELECT m.node_id, m.paper_id, m.sort_order FROM mem m LEFT JOIN f ON m.paper_id = f.paper_id AND m.node_id = f.a WHERE f.paper_id IS NULL",
)
def _(spark, root):
    m = members(spark, root)
    moves = m.groupBy("paper_id").agg(F.count("*").alias("n"), F.min("node_id").alias("from_node"), F.max("node_id").alias("to_node")).where("n > 1").drop("n")
    return D.moved(m, moves, "node_id", "paper_id")


@query(
    "mrg_02_sections",
    "WITH h AS (SELECT * FROM layout_blocks WHERE block_role = 'heading'), f AS (SELECT paper_id, block_id, arg_min(coalesce(text, ''), updated_at) t FROM h GROUP BY 1, 2), l AS (SELECT paper_id, block_id, arg_max(coalesce(text, ''), updated_at) t FROM h WHERE updated_at > created_at GROUP BY 1, 2) "
    "SELECT paper_id, block_id, CASE WHEN l.block_id IS NULL OR (f.t <> '' AND l.t = '') THEN f.t ELSE l.t END AS text FROM f LEFT JOIN l USING (paper_id, block_id)",
)
def _(spark, root):
    h = table(spark, root, "layout_blocks", "paper_id", "block_id", "block_role", "text", "created_at", "updated_at").where("block_role = 'heading'")
    text = F.coalesce("text", F.lit(""))
    old = h.groupBy("paper_id", "block_id").agg(F.min_by(text, "updated_at").alias("text"))
    new = h.where("updated_at > created_at").groupBy("paper_id", "block_id").agg(F.max_by(text, "updated_at").alias("text"))
    return M.prefer_filled(old, new, ["paper_id", "block_id"], "text")


@query("glo_04_parsed", "SELECT entry_id, trim(term) term, trim(translation) AS translation FROM glossary_entries WHERE length(trim(term)) > 0")
def _(spark, root):
    g = table(spark, root, "glossary_entries", "entry_id", "term", "translation")
    entry = F.to_json(F.array(F.struct("term", "translation")))
    d = g.select("entry_id", F.concat(F.lit("Here it is:\n"), entry, F.lit("\nAsk me [again].")).alias("answer"))
    e = d.select("entry_id", F.inline(D.json_entries(F.col("answer"), "array<struct<term:string,translation:string>>")))
    return e.select("entry_id", F.trim("term").alias("term"), F.trim("translation").alias("translation")).where("length(term) > 0")


@query("glo_05_reapplied")
def _(spark, root):
    g = table(spark, root, "glossary_entries", "term", "translation", "target_language").where("target_language = 'ja'").select("term", "translation").distinct().collect()  # a fixed table
    entries = tuple(sorted({r.term: r.translation for r in g}.items()))
    r = results(spark, root, "text", "target_language").where("text IS NOT NULL AND target_language = 'ja'")
    return r.select("result_id", C.glossary_column(F.col("text"), entries).alias("text"))


@query("seg_09_repaired", "SELECT task_id, regexp_replace(regexp_replace(text, '\\b([Ii])ts not\\b', '\\1t is not', 'g'), '\\b([Nn]either [^,.;]+), nor\\b', '\\1 nor', 'g') AS text FROM translation_tasks")
def _(spark, root):
    return table(spark, root, "translation_tasks", "task_id", "text").select("task_id", D.repaired_input(F.col("text")).alias("text"))


@query("seg_10_inputs")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "text").where("text IS NOT NULL")
    return t.select("task_id", F.posexplode(F.transform(G.units_column(F.col("text")), D.repaired_input)).alias("place", "model_input"))


@query(
    "jon_02_heading_numbers",
    _BLK + ", h AS (SELECT paper_id, block_id, text, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s+\\S', 1) num FROM blk WHERE block_role = 'heading' AND text IS NOT NULL) "
    "SELECT paper_id, block_id, num, CASE WHEN num <> '' THEN regexp_replace(text, '^\\s*[0-9]+(?:\\.[0-9]+)*\\.?\\s+', '') ELSE trim(text) END rest FROM h",
)
def _(spark, root):
    h = blocks(spark, root, "block_role", "text").where("block_role = 'heading' AND text IS NOT NULL")
    num, rest = D.heading_number(F.col("text"))
    return h.select("paper_id", "block_id", num.alias("num"), rest.alias("rest"))


@query("agg_03_active", "SELECT priority, count(*) n, count(*) FILTER (status IN ('queued', 'running', 'translating')) n_active FROM translation_tasks GROUP BY 1")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "priority", "status")
    return t.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("queued", "running", "translating")).alias("n_active"))


def _pairs(spark, root, *cols):
    r = results(spark, root, "task_id", "text", *cols).where("text IS NOT NULL")
    return r.join(table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text"), "task_id")


@query("qlt_03_signs")
def _(spark, root):
    return results(spark, root, "text").where("text IS NOT NULL").select("result_id", F.concat_ws(",", X.signs_column(F.col("text"))).alias("signs"))


@query("qlt_06_foreign_share")
def _(spark, root):
    return _pairs(spark, root).select("result_id", F.round(X.foreign_share_column(F.col("source_text"), F.col("text")), 6).alias("share"))


@query("qlt_07_bare_facts")
def _(spark, root):
    return _pairs(spark, root).select("result_id", X.bare_facts_column(F.col("source_text"), F.col("text")).alias("bare"))


@query(
    "lay_13_first_page",
    _LIN + ", f AS (SELECT line_id, paper_id, page, line_no, text, y_top y, height, coalesce(font_size, height * 0.9) fs FROM lin), base AS (SELECT paper_id, median(fs) body FROM f WHERE length(text) > 40 GROUP BY 1), "
    "p AS (SELECT f.*, body, regexp_matches(text, '(?i)^\\s*(?:[0-9]+\\.?\\s*)?(?:abstract|introduction|zusammenfassung|einleitung|要旨|概要|はじめに|序論)\\s*$') starts FROM f JOIN base USING (paper_id) WHERE page = 1 AND trim(text) <> ''), "
    "g AS (SELECT paper_id, max(fs) FILTER (length(trim(text)) >= 8) mx, min(y) FILTER (starts) named, any_value(body) body FROM p GROUP BY 1), t AS (SELECT paper_id, CASE WHEN mx >= body * 1.28 THEN mx ELSE 0 END tf, named FROM g), "
    "q AS (SELECT p.*, tf FROM p JOIN t USING (paper_id)), b AS (SELECT paper_id, arg_min(y + greatest(18.0, height), line_no) below FROM q WHERE tf > 0 AND fs >= greatest(tf * 0.9, body * 1.28) AND length(trim(text)) BETWEEN 8 AND 180 AND NOT starts GROUP BY 1), "
    "c AS (SELECT q.paper_id, arg_min(y, line_no) body_y FROM q LEFT JOIN b USING (paper_id) WHERE y > coalesce(below, 70.0) AND fs <= body * 1.08 AND length(trim(text)) > 50 GROUP BY 1) "
    "SELECT t.paper_id, round(tf, 6)::DOUBLE title_font, round(coalesce(named, body_y, -1.0), 6)::DOUBLE masthead_end FROM t LEFT JOIN c USING (paper_id)",
)
def _(spark, root):
    d = lines(spark, root, "paper_id", "page", "line_no", "text", "y_top", "height", "font_size").withColumnRenamed("y_top", "y").withColumn("font_size", F.coalesce("font_size", F.col("height") * 0.9))
    base = d.where(F.length("text") > 40).groupBy("paper_id").agg(F.median("font_size").alias("body_font"))
    p = D.first_page(d, base, "paper_id")
    return p.select("paper_id", F.round("title_font", 6).alias("title_font"), F.round("masthead_end", 6).alias("masthead_end"))


def _boxes(spark, root):
    b = blocks(spark, root, "block_order", "block_role", "page_start", "column_side", "bbox", "text")
    return b.select("paper_id", "block_id", "block_order", F.col("block_role").alias("role"), F.col("page_start").alias("page"), F.col("column_side").alias("side"), "text", F.col("bbox.x_left").alias("x"), F.col("bbox.y_top").alias("y"), F.col("bbox.width").alias("w"), F.col("bbox.height").alias("h"))


@query(
    "lay_18_crops",
    _BLK + ", d AS (SELECT paper_id, block_id, block_role r, page_start p, column_side s, bbox.x_left x, bbox.y_top y, bbox.width w, bbox.height h FROM blk), "
    "c AS (SELECT *, CASE WHEN s = 'right' THEN 314.0 ELSE 44.0 END bx, CASE WHEN s = 'left' THEN 252.0 WHEN s = 'right' THEN 280.0 ELSE 550.0 END bw FROM d WHERE r = 'caption'), "
    "k AS (SELECT c.paper_id, c.block_id, max(o.y + o.h) b FROM c JOIN d o ON c.paper_id = o.paper_id AND c.p = o.p AND o.block_id <> c.block_id AND o.r <> 'figure' AND o.y + o.h <= c.y - 2 AND o.x < c.bx + c.bw AND o.x + o.w > c.bx GROUP BY 1, 2), "
    "m AS (SELECT c.*, c.y - 6 - greatest(coalesce(k.b, 48.0), 48.0) tall, greatest(0.0, least(bx, x) - 6) cx, least(612.0, greatest(bx + bw, x + w) + 6) rx FROM c LEFT JOIN k USING (paper_id, block_id)) "
    "SELECT paper_id, block_id, p page, round(cx, 4)::DOUBLE crop_x, round(y - 3 - least(tall, 459.36), 4)::DOUBLE crop_y, round(greatest(24.0, rx - cx), 4)::DOUBLE crop_w, round(least(tall, 459.36), 4)::DOUBLE crop_h FROM m WHERE tall >= 36",
)
def _(spark, root):
    d = D.crops(_boxes(spark, root), "paper_id")
    return d.select("paper_id", "block_id", "page", *[F.round(c, 4).alias(c) for c in ("crop_x", "crop_y", "crop_w", "crop_h")])


@query(
    "lay_24_dump",
    _BLK + ", d AS (SELECT paper_id, block_id, page_start p, column_side s, coalesce(text, '[figure]') t, lag(page_start) OVER w pp, lag(column_side) OVER w ps FROM blk WINDOW w AS (PARTITION BY paper_id ORDER BY block_order, block_id)) "
    "SELECT paper_id, block_id, CASE WHEN pp IS NULL OR pp <> p THEN '== page ' || p || ' ==' || chr(10) WHEN ps <> s THEN '-- ' || s || ' --' || chr(10) ELSE '' END || t line FROM d",
)
def _(spark, root):
    return D.reading_dump(_boxes(spark, root), "paper_id")


@query(
    "str_08_evidence",
    _BLK + "SELECT paper_id, max(page_start) n_pages, " + ", ".join(f"count(*) FILTER (block_role = '{r}') n_{r}" for r in ("heading", "paragraph", "caption", "reference", "footnote", "list", "figure"))
    + ", len(list_distinct(flatten(list(regexp_extract_all(coalesce(text, ''), '10\\.[0-9]{4,9}/[0-9A-Za-z._;()/:-]+')))))::BIGINT n_dois FROM blk GROUP BY 1",
)
def _(spark, root):
    return D.evidence(_boxes(spark, root), "paper_id")
