"""Catalog, projection and repair queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lectorium.functions import segments as G
from lectorium.operators import catalog as C
from lectorium.operators import citations as R
from lectorium.plans.library import _ANN, _BLK, _CUR, _RES, blocks, current, notes, results
from lectorium.plans.registry import query
from lectorium.plans.text import _PLACED, reanchored
from lectorium.sources import packages as P
from lectorium.sources.tables import table


@query("hlp_04_pending", "SELECT task_id FROM translation_tasks WHERE task_id IN (SELECT task_id FROM translation_results) AND task_id NOT IN (SELECT task_id FROM translation_results WHERE text IS NOT NULL AND output_tokens IS NOT NULL)")
def _(spark, root):
    r = table(spark, root, "translation_results", "task_id", "text", "output_tokens")
    return C.pending(table(spark, root, "translation_tasks", "task_id"), r, r.where("text IS NOT NULL AND output_tokens IS NOT NULL"), "task_id")


@query("hlp_02_authors", _CUR + "SELECT id, id || '-a' || (u.ord - 1) author_id, (u.ord - 1)::INT ord, u.name AS name FROM cur, unnest(authors) WITH ORDINALITY u(name, ord)")
def _(spark, root):
    return C.projected_authors(current(spark, root, "authors"))


@query("hlp_12_pdf_names", _CUR + "SELECT id FROM cur WHERE lower(trim(source_file_name)) LIKE '%.pdf'")
def _(spark, root):
    return current(spark, root, "source_file_name").where(C.pdf_name(F.col("source_file_name"))).select("id")


@query("hlp_13_error_classes", "SELECT CASE WHEN regexp_matches(lower(error), 'password|encrypt') THEN 'encrypted' WHEN regexp_matches(lower(error), 'invalid pdf|missing pdf|corrupt') THEN 'invalid' WHEN regexp_matches(lower(error), 'network|fetch|timeout') THEN 'network' ELSE 'unknown' END kind, count(*) n FROM translation_tasks WHERE error IS NOT NULL GROUP BY 1")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "error").where("error IS NOT NULL")
    return t.groupBy(C.open_error(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


@query("hlp_09_visible", _BLK + "SELECT paper_id, count(*) n FROM blk WHERE block_role <> 'heading' AND text IS NOT NULL GROUP BY 1")
def _(spark, root):
    return C.visible(blocks(spark, root, "block_role", "text")).groupBy("paper_id").agg(F.count("*").alias("n"))


@query("lib_20_write_through", _CUR + ", " + _ANN + ", l AS (SELECT paper_id, arg_max(block_id, (updated_at, block_id)) last_block, max(updated_at) last_read FROM ann GROUP BY 1) SELECT id, last_block, last_read FROM cur LEFT JOIN l ON l.paper_id = cur.id")
def _(spark, root):
    p = notes(spark, root, "paper_id", "block_id", "updated_at")
    return C.written_through(p, current(spark, root)).select("id", "last_block", "last_read")


@query(
    "snk_10_structure_edges",
    _BLK + ", s AS (SELECT paper_id, block_id, block_order, block_role, last_value(CASE WHEN block_role = 'heading' THEN block_id END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY block_order, block_id ROWS UNBOUNDED PRECEDING) sec FROM blk), b AS (SELECT * FROM s WHERE block_role <> 'heading'), "
    "r AS (SELECT paper_id, 'READS_BEFORE' AS type, block_id source, lead(block_id) OVER (PARTITION BY paper_id ORDER BY block_order, block_id) target FROM b) SELECT * FROM r WHERE target IS NOT NULL UNION ALL SELECT paper_id, 'CHILD_OF', block_id, sec FROM b WHERE sec IS NOT NULL",
)
def _(spark, root):
    return C.structure_edges(blocks(spark, root, "block_order", "block_role"))


@query(
    "snk_11_rejoined",
    _BLK + ", t AS (SELECT paper_id, block_id, arg_max(text, task_id) AS text FROM translation_tasks WHERE text <> '' GROUP BY 1, 2) SELECT blk.paper_id, blk.block_id, md5(coalesce(nullif(t.text, ''), nullif(blk.text, ''))) h FROM blk LEFT JOIN t USING (paper_id, block_id)",
)
def _(spark, root):
    b = blocks(spark, root, "text")
    t = table(spark, root, "translation_tasks", "task_id", "paper_id", "block_id", "text").where("text <> ''").groupBy("paper_id", "block_id").agg(F.max_by("text", "task_id").alias("text"))
    return C.rejoined(b.select("paper_id", "block_id"), [t, b], ["paper_id", "block_id"]).select("paper_id", "block_id", F.md5("text").alias("h"))


_RULES = [(r"(?i)\bmemory\b", "メモリ", "記憶"), (r"(?i)\btrial\b", "審理", "試験")]


@query(
    "glo_02_repaired",
    _RES + ", d AS (SELECT result_id, t.text s, r.text o FROM res r JOIN translation_tasks t USING (task_id) WHERE r.text IS NOT NULL AND r.target_language = 'ja'), e AS (SELECT result_id, s, CASE WHEN regexp_matches(s, '(?i)\\bmemory\\b') THEN replace(o, 'メモリ', '記憶') ELSE o END o FROM d) "
    "SELECT result_id, md5(CASE WHEN regexp_matches(s, '(?i)\\btrial\\b') THEN replace(o, '審理', '試験') ELSE o END) h FROM e",
)
def _(spark, root):
    r = results(spark, root, "task_id", "text", "target_language").where("text IS NOT NULL AND target_language = 'ja'")
    t = table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text")
    return r.join(t, "task_id").select("result_id", F.md5(C.repaired_terms(F.col("source_text"), F.col("text"), _RULES)).alias("h"))


@query("mig_05_imported", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 3 = 0")
def _(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_name")
    legacy = p.select("p_partkey", F.upper("p_name").alias("p_name"))
    once = C.imported(p.where("p_partkey % 3 <> 0"), legacy, ["p_partkey"])
    return C.imported(once, legacy, ["p_partkey"])


@query("mig_03_left_joined", "SELECT n_nationkey, coalesce(s.s_name, n_name) AS label FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) s_name FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s.s_nationkey = n_nationkey")
def _(spark, root):
    s = table(spark, root, "supplier", "s_nationkey", "s_name", "s_acctbal").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("s_name"))
    n = table(spark, root, "nation", "n_nationkey", "n_name")
    return n.join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("s_name", "n_name").alias("label"))


@query("agg_10_gold_report")
def _(spark, root):
    from lectorium.operators import evaluation as E

    b = blocks(spark, root, "block_order", "block_role", "text")
    g = b.groupBy(F.col("paper_id")).agg(F.collect_list(F.when(F.col("block_role") == "heading", F.col("text"))).alias("headings"), F.collect_list(F.when(F.col("block_role") == "caption", F.col("text"))).alias("captions"))
    p = b.groupBy("paper_id").agg(F.collect_list(F.when(F.length("text") < 60, F.col("text"))).alias("short"))
    pr, re, f1 = E.set_scores(F.col("short"), F.col("headings"))
    d = C.gold_report(p, g, "paper_id", {"heading_precision": (pr, F.col("headings")), "heading_recall": (re, F.col("headings")), "heading_f1": (f1, F.col("headings")), "caption_recall": (E.substring_recall(F.col("short"), F.col("captions")), F.col("captions"))})
    return d


@query("agg_11_hit_rate", _CUR + "SELECT round(avg((title_original = title_translated)::INT), 6) rate, count(title_translated) n FROM cur")
def _(spark, root):
    c = current(spark, root, "title_original", "title_translated")
    return c.agg(F.round(F.avg((F.col("title_original") == F.col("title_translated")).cast("int")), 6).alias("rate"), F.count("title_translated").alias("n"))


@query("cit_04_resolved")
def _(spark, root):
    b = blocks(spark, root, "block_role", "text").where("text IS NOT NULL")
    return R.resolved(b, R.unique_references(b, "paper_id", "block_id", "block_role"), "paper_id").where("size(keys) > 0").select("paper_id", "block_id", F.concat_ws(",", F.transform("keys", lambda x: x.cast("string"))).alias("keys"), "target")


@query("cit_05_links", "SELECT doc_id, unnest([{'start': length(text) + 5, 'stop': length(text) + 26, 'href': 'https://a.example/x,y'}, {'start': length(text) + 32, 'stop': length(text) + 44, 'href': 'https://doi.org/10.1234/ab.c'}], recursive := true) FROM documents WHERE text IS NOT NULL")
def _(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")
    d = d.withColumn("text", F.concat("text", F.lit(" See https://a.example/x,y. and 10.1234/ab.c")))
    return d.select("doc_id", F.inline(R.links_column(F.col("text"))))


@query("cit_06_linked", "SELECT l_orderkey k, l_linenumber n, 'see [' || l_linenumber || ']' || CASE WHEN l_linenumber <= 2 THEN '(#b' || l_linenumber || ')' ELSE '' END || ' and [9], [1](#x)' AS text FROM lineitem")
def _(spark, root):
    d = table(spark, root, "lineitem", "l_orderkey", "l_linenumber")
    t = F.concat(F.lit("see ["), F.col("l_linenumber").cast("string"), F.lit("] and [9], [1](#x)"))
    m = F.create_map(F.lit("1"), F.lit("b1"), F.lit("2"), F.lit("b2"))
    return d.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), R.linked(t, m).alias("text"))


@query("ann_04_changed", _PLACED + "SELECT id, start start_offset, start + n end_offset, status FROM r WHERE start <> s OR (status = 'orphaned') <> (old = 'orphaned')")
def _(spark, root):
    d = reanchored(spark, root).where((F.col("r.start") != F.col("start_offset")) | ((F.col("r.status") == "orphaned") != (F.col("status") == "orphaned")))
    return d.select("id", F.col("r.start").alias("start_offset"), (F.col("r.start") + F.length("selected_text")).alias("end_offset"), F.col("r.status").alias("status"))


@query("prt_02_spans")
def _(spark, root):
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def spans(c: pd.Series) -> pd.Series:
        return pd.Series([G.protected(x) for x in c], dtype=object)

    d = table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")
    d = d.select("doc_id", "text", F.explode(spans("text")).alias("s"))
    return d.select("doc_id", F.col("s.a").alias("start"), F.col("s.b").alias("stop"), F.substring(F.col("text"), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("span"))


@query("src_05_missing_packages", _CUR + "SELECT id doc_id FROM cur WHERE id NOT IN (SELECT paper_id FROM layout_blocks)")
def _(spark, root):
    return P.missing_packages(current(spark, root).select(F.col("id").alias("doc_id")), table(spark, root, "layout_blocks", "paper_id").withColumnRenamed("paper_id", "doc_id"))


@query("stm_03_reprioritized", "SELECT task_id, CASE WHEN status = 'queued' AND f.paper_id IS NOT NULL THEN 0 ELSE priority END priority FROM translation_tasks t LEFT JOIN (SELECT DISTINCT paper_id, block_id FROM annotations) f USING (paper_id, block_id)")
def _(spark, root):
    from lectorium.streaming import increments as I

    t = table(spark, root, "translation_tasks", "task_id", "paper_id", "block_id", "priority", "status")
    f = table(spark, root, "annotations", "paper_id", "block_id").distinct().withColumn("priority", F.lit(0))
    return I.reprioritized(t, f).select("task_id", "priority")
