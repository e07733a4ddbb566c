"""Structure, predicate and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions import predicates as P
from lectorium.functions import text as T
from lectorium.operators import layout as L
from lectorium.operators import quality as Q
from lectorium.operators import structure as S
from lectorium.plans.layout import _IT, boxes, items, pages
from lectorium.plans.library import _BLK, _CUR, _RES, blocks, current, results
from lectorium.operators.versions import latest
from lectorium.plans.registry import query
from lectorium.sources.tables import table

_ALT = "'^\\s*(?:(?:Figure|Fig\\.|Abb\\.|Abbildung)\\s*\\d+[.:]?\\s|図\\s*\\d+)'"


@query(
    "prd_01_captions",
    _BLK + f"SELECT block_role, count(*) n, count(*) FILTER (regexp_matches(text, {_ALT})) n_figure, count(*) FILTER (regexp_matches(text, '^\\s*(?:(?:Table|Tab\\.|Tabelle)\\s*\\d+[.:]\\s|表\\s*\\d+[.:：　\\s])')) n_table FROM blk GROUP BY 1",
)
def _(spark, root):
    b = blocks(spark, root, "block_role", "text")
    return b.groupBy("block_role").agg(F.count("*").alias("n"), F.count_if(P.figure_caption(F.col("text"))).alias("n_figure"), F.count_if(P.table_caption(F.col("text"))).alias("n_table"))


@query(
    "prd_04_headings",
    _BLK + "SELECT block_role, count(*) FILTER (regexp_matches(text, '^\\s*\\d+(?:\\.\\d+)*\\.?\\s+\\p{L}[^.!?。]{0,60}$')) n_numbered FROM blk GROUP BY 1",
)
def _(spark, root):
    return blocks(spark, root, "block_role", "text").groupBy("block_role").agg(F.count_if(P.numbered_heading(F.col("text"))).alias("n_numbered"))


@query(
    "prd_06_references",
    _BLK + "SELECT block_role, count(*) FILTER (regexp_matches(text, '^\\s*(?:\\[\\d+\\]\\s*)?\\p{Lu}[\\p{L}''’-]+, (?:\\p{Lu}\\.[ ,&]*)+.*\\((?:18|19|20)\\d{2}[a-z]?\\)') AND regexp_matches(text, '\\d+[–-]\\d+|\\d+\\(\\d+\\)|pp?\\. \\d+')) n_reference FROM blk GROUP BY 1",
)
def _(spark, root):
    return blocks(spark, root, "block_role", "text").groupBy("block_role").agg(F.count_if(P.bibliography_like(F.col("text"))).alias("n_reference"))


@query("prd_07_names", _CUR + ", a AS (SELECT DISTINCT unnest(authors) a FROM cur) SELECT a AS name, regexp_matches(a, '^\\s*(?:\\p{Lu}\\.|\\p{Lu}[\\p{L}''’-]+)(?:\\s+(?:\\p{Lu}\\.|\\p{Lu}[\\p{L}''’-]+)){1,3}\\s*$') is_name FROM a")
def _(spark, root):
    a = current(spark, root, "authors").select(F.explode("authors").alias("name")).distinct()
    return a.select("name", P.person_name(F.col("name")).alias("is_name"))


@query("cap_01_labels", _BLK + "SELECT paper_id, block_id, nullif(regexp_extract(text, '^\\s*((?:Figure|Fig\\.|Abb\\.|Table|Tab\\.|Tabelle|図|表)\\s*\\d+)', 1), '') AS label FROM blk WHERE block_role = 'caption'")
def _(spark, root):
    return blocks(spark, root, "block_role", "text").where("block_role = 'caption'").select("paper_id", "block_id", P.caption_label(F.col("text")).alias("label"))


@query("lay_14_line_roles")
def _(spark, root):
    it = items(spark, root)
    base = it.where(F.length("text") > 40).groupBy("doc_id").agg(F.coalesce(F.when(F.median("font_size") != 0, F.median("font_size")), F.lit(10.0)).alias("body_font"))
    d = it.join(base, "doc_id", "left").fillna({"body_font": 10.0})
    return d.select("doc_id", "page", "item_ix", P.line_role(F.col("text"), F.col("font_size"), F.col("body_font")).alias("role"))


@query("lay_23_body_font", _IT + "SELECT doc_id, round(coalesce(nullif(median(font_size), 0), 10), 6)::DOUBLE body_font FROM it WHERE length(text) > 40 GROUP BY 1")
def _(spark, root):
    g = items(spark, root).where(F.length("text") > 40).groupBy("doc_id").agg(F.median("font_size").alias("m"))
    return g.select("doc_id", F.round(F.coalesce(F.when(F.col("m") != 0, F.col("m")), F.lit(10.0)), 6).alias("body_font"))


@query("lay_15_blocks")
def _(spark, root):
    d = table(spark, root, "page_lines", "line_id", "paper_id", "page", "line_no", "text", "y_top", "height", "font_size", "ingested_at")
    d = latest(d, ["line_id"], ["ingested_at"]).withColumn("font_size", F.coalesce("font_size", F.col("height") * 0.9))
    body = d.where(F.length("text") > 40).groupBy("paper_id").agg(F.median("font_size").alias("body"))
    d = d.join(body, "paper_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    lines = d.select(F.col("paper_id").alias("doc_id"), "page", F.col("line_no").alias("place"), "text", F.col("y_top").alias("line_y"), "height", P.line_role(F.col("text"), F.col("font_size"), F.col("body")).alias("role"))
    g = S.grouped_lines(lines).groupBy("doc_id", "page", "block_no")
    pieces = F.array_sort(F.collect_list(F.struct("place", "text")))
    return g.agg(F.count("*").alias("n_lines"), F.min("role").alias("role"), S.hyphen_joined(F.transform(pieces, lambda x: x["text"])).alias("text"))


@query(
    "lay_16_continued",
    _BLK + ", d AS (SELECT paper_id, block_id, block_role, text, last_value(CASE WHEN block_role = 'paragraph' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY block_order, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM blk) "
    "SELECT paper_id, block_id FROM d WHERE block_role = 'paragraph' AND NOT regexp_matches(rtrim(b), '[.!?。．！？:：][\"”’)\\]」』]*$') AND regexp_matches(text, '^\\s*[\\p{Ll}(]')",
)
def _(spark, root):
    return S.continued(blocks(spark, root, "block_order", "block_role", "text")).where("continues").select("paper_id", "block_id")


@query(
    "lay_10_without_chrome",
    _IT + ", e AS (SELECT DISTINCT doc_id, page, regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS key FROM it WHERE y < 63.36 OR y > 792 - 55.44), "
    "n AS (SELECT doc_id, count(*) n_all FROM pg GROUP BY 1), c AS (SELECT doc_id, key FROM e JOIN n USING (doc_id) WHERE length(key) BETWEEN 4 AND 140 GROUP BY doc_id, key, n_all HAVING count(*) >= greatest(2, floor(n_all * 0.28))) "
    "SELECT doc_id, page, count(*) n FROM it WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = it.doc_id AND c.key = regexp_replace(regexp_replace(lower(trim(it.text)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) GROUP BY 1, 2",
)
def _(spark, root):
    it = items(spark, root)
    chrome = L.repeated_chrome(it, pages(it))
    kept = it.withColumn("key", L.chrome_key(F.col("text"))).join(chrome.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query(
    "str_07_confidence",
    _BLK + ", c AS (SELECT paper_id, block_id, ((CASE WHEN length(trim(text)) >= 3 OR block_role = 'figure' THEN 1.0 ELSE 0.3 END + CASE WHEN bbox.width > 0 AND bbox.height > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN lag(page_start) OVER w = page_start AND lag(bbox.y_top) OVER w > bbox.y_top + 400 THEN 0.6 ELSE 1.0 END "
    "+ coalesce(extraction_confidence, 1.0)) / 4)::DOUBLE s FROM blk WINDOW w AS (PARTITION BY paper_id ORDER BY block_order, block_id)) SELECT paper_id, block_id, (floor(s * 100 + 0.5) / 100)::DOUBLE confidence, CASE WHEN floor(s * 100 + 0.5) / 100 >= 0.9 THEN 'high' WHEN floor(s * 100 + 0.5) / 100 >= 0.7 THEN 'medium' ELSE 'low' END band FROM c",
)
def _(spark, root):
    return S.block_confidence(blocks(spark, root, "block_order", "block_role", "text", "page_start", "bbox", "extraction_confidence")).select("paper_id", "block_id", "confidence", "band")


@query(
    "str_12_fused_role",
    "WITH v AS (SELECT paper_id || '/' || block_id AS key, producer, block_role AS value, coalesce(extraction_confidence, 1.0) c, block_order ord FROM layout_blocks), g AS (SELECT key, value, sum(CASE producer WHEN 'tei' THEN 0.9 WHEN 'native' THEN 0.8 WHEN 'ocr' THEN 0.4 ELSE 0.5 END * c) s, min(ord) ord FROM v GROUP BY 1, 2) "
    "SELECT key, first(value ORDER BY s DESC, ord) AS value, round(max(s), 6)::DOUBLE score FROM g GROUP BY 1",
)
def _(spark, root):
    b = table(spark, root, "layout_blocks", "paper_id", "block_id", "producer", "block_role", "extraction_confidence", "block_order")
    v = b.select(F.concat_ws("/", "paper_id", "block_id").alias("key"), F.col("producer").alias("source"), F.col("block_role").alias("value"), F.coalesce("extraction_confidence", F.lit(1.0)).alias("confidence"), F.col("block_order").alias("ord"))
    return S.fused(v, {"tei": 0.9, "native": 0.8, "ocr": 0.4}, "key")


@query("str_09_formats")
def _(spark, root):
    t = items(spark, root).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(L.chrome_key(F.col("text")))), " | ").alias("text"))
    rules = {"proceedings": [(r"northlake proceedings", 0.5), (r"proceedings, vol", 0.4)], "journal": [(r"journal of|annals of|transactions on", 0.5), (r"vol\. #", 0.35)], "workshop": [(r"workshop notes", 0.9)]}
    return S.detected_format(t, rules, "text", "doc_id")


@query("str_19_topological")
def _(spark, root):
    return S.topological_order(L.reading_edges(blocks(spark, root, "block_order")), "paper_id")


@query(
    "str_20_caption_regions",
    "WITH b AS (SELECT paper_id, page_start page, block_id id, block_role, bbox.x_left x, bbox.y_top y, bbox.width width, bbox.height height FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at DESC) k FROM layout_blocks) WHERE k = 1) "
    "SELECT b.paper_id, b.page, c.id caption, round(min(b.x), 4) x, round(min(b.y), 4) y, round(max(b.x + b.width), 4) AS right, round(max(b.y + b.height), 4) bottom, count(*) n FROM b JOIN b c ON b.paper_id = c.paper_id AND b.page = c.page AND c.block_role = 'caption' AND b.id <> c.id AND b.y + b.height <= c.y + 1 AND b.y >= c.y - 280 GROUP BY 1, 2, 3",
)
def _(spark, root):
    b = blocks(spark, root, "page_start", "block_role", "bbox").select("paper_id", F.col("page_start").alias("page"), F.col("block_id").alias("id"), "block_role", F.col("bbox.x_left").alias("x"), F.col("bbox.y_top").alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"))
    return S.below_captions(b.where("block_role = 'caption'"), b)


@query(
    "str_22_section_kinds",
    _BLK + ", h AS (SELECT paper_id, block_id, lower(trim(regexp_replace(trim(text), '^(?:\\d+(?:\\.\\d+)*\\.?|[IVX]+\\.)\\s+', ''))) h FROM blk WHERE block_role = 'heading') SELECT paper_id, block_id, CASE "
    + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{k}'" for k, p in P.SECTION_KINDS)
    + " ELSE 'other' END kind FROM h",
)
def _(spark, root):
    return blocks(spark, root, "block_role", "text").where("block_role = 'heading'").select("paper_id", "block_id", P.section_kind(F.col("text")).alias("kind"))


@query("str_17_affiliated")
def _(spark, root):
    n = table(spark, root, "customer", "c_custkey", "c_nationkey")
    a = n.select(F.col("c_nationkey").cast("string").alias("doc"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).cast("int").alias("ord"), F.array((F.col("c_custkey") % 3).cast("string")).alias("markers"))
    s = table(spark, root, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").cast("string").alias("doc"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("int").alias("ord"), F.array((F.col("s_suppkey") % 4).cast("string")).alias("markers"))
    return S.affiliated(a, s, "doc")


@query("aud_03_flags")
def _(spark, root):
    r = results(spark, root, "task_id", "text").where("text IS NOT NULL")
    t = table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text")
    d = r.join(t, "task_id")
    why = Q.reasons(copied=Q.source_copied(F.col("source_text"), F.col("text")), loop=Q.five_gram_loop(F.col("text")), short=Q.length_score(F.col("source_text"), F.col("text")) < 1)
    return d.select("result_id", F.concat_ws(",", why).alias("reasons"))


@query("qlt_04_composite")
def _(spark, root):
    from lectorium.functions import facts as X

    r = results(spark, root, "task_id", "text", "target_language").where("text IS NOT NULL")
    t = table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text")
    d = r.join(t, "task_id").withColumn("p", X.preservation_column(F.col("source_text"), F.col("text")))
    ja = T.japanese_ratio(F.col("text"))
    lang = F.when(F.col("target_language") == "ja", F.least(ja * 2, F.lit(1.0))).otherwise(1 - ja)
    rep = F.when(Q.five_gram_loop(F.col("text")) | X.long_run(F.col("text")), 0.0).otherwise(1.0)
    return d.select("result_id", Q.composite(lang, F.col("p.score"), rep, Q.length_score(F.col("source_text"), F.col("text"))).alias("score"))


@query("agg_05_exact_titles", _CUR + "SELECT count(*) n, count(*) FILTER (lower(trim(title_original)) = lower(trim(title_translated))) n_equal FROM cur")
def _(spark, root):
    c = current(spark, root, "title_original", "title_translated")
    same = F.lower(F.trim(T.normalized(F.col("title_original")))) == F.lower(F.trim(T.normalized(F.col("title_translated"))))
    return c.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"))


@query("hlp_05_batches")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "text").where("text IS NOT NULL")
    j = t.select(F.col("task_id").alias("job_id"), F.length("text").alias("size"), Q.length_bucket(F.length("text")).alias("bucket"), F.pmod(F.xxhash64("task_id"), F.lit(16)).cast("int").alias("shard"))
    return Q.batch_plan(j)


@query(
    "inf_04_neighbours",
    _BLK + "SELECT paper_id, block_id, md5(lag(text) OVER w) before_, md5(lead(text) OVER w) behind FROM blk WHERE block_role = 'paragraph' AND text IS NOT NULL WINDOW w AS (PARTITION BY paper_id ORDER BY block_order, block_id)",
)
def _(spark, root):
    n = Q.neighbours(blocks(spark, root, "block_order", "block_role", "text"), (F.col("block_role") == "paragraph") & F.col("text").isNotNull())
    return n.select("paper_id", "block_id", F.md5("text_before").alias("before_"), F.md5("text_behind").alias("behind"))


@query("hlp_01_replaced_pages", _IT + "SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN 'ocr' ELSE 'native' END source, count(*) n FROM it GROUP BY 1, 2, 3")
def _(spark, root):
    it = items(spark, root)
    return S.replaced_pages(it, it.where("page % 3 = 0"), ["doc_id", "page"]).groupBy("doc_id", "page", "source").agg(F.count("*").alias("n"))
