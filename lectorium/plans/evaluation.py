"""Evaluation and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.operators import evaluation as E
from lectorium.plans.library import _BLK, _CUR, _RES, blocks, current, results
from lectorium.plans.registry import query
from lectorium.sources.tables import table


def docs(spark, root, *cols):
    return table(spark, root, "documents", "doc_id", *cols)


@query(
    "agg_01_duplicate_groups",
    "WITH h AS (SELECT sha256(text) k, array_agg(doc_id ORDER BY created_at, doc_id) members FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1), "
    "taken AS (SELECT unnest(members) doc_id FROM h), "
    "t AS (SELECT md5(lower(trim(text))) k, array_agg(doc_id ORDER BY created_at, doc_id) members FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM taken) GROUP BY lower(trim(text)) HAVING count(*) > 1) "
    "SELECT 'hash' kind, array_to_string(members, ',') members FROM h UNION ALL SELECT 'title', array_to_string(members, ',') FROM t",
)
def _(spark, root):
    d = docs(spark, root, "text", "created_at").withColumns({"h": F.sha2("text", 256), "t": F.md5(F.lower(F.trim("text")))})
    g = E.duplicate_groups(d.where("text IS NOT NULL").select("doc_id", "h", "t", "created_at"), "doc_id", "h", "t", "created_at")
    return g.select("kind", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


@query("agg_02_cleanup", _CUR + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_file_hash ORDER BY created_at, id) k FROM cur) WHERE k > 1")
def _(spark, root):
    return E.keep_oldest(current(spark, root, "source_file_hash", "created_at"), "source_file_hash", "created_at", "id").select("id")


@query("agg_03_queue", "SELECT count(*) FILTER (priority = 0) n_0, count(*) FILTER (priority = 1) n_1, count(*) FILTER (priority = 2) n_2, count(*) FILTER (priority = 3) n_3, count(*) total FROM translation_tasks")
def _(spark, root):
    return E.status_counts(table(spark, root, "translation_tasks", "priority"), "priority", [0, 1, 2, 3])


_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda x: x <> ''))"


@query(
    "agg_04_set_scores",
    "WITH p AS (SELECT a.text ta, b.text tb, a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL AND a.lang = 'en'), "
    f"w AS (SELECT doc_id, {_W.format('ta')} p, {_W.format('tb')} g FROM p), s AS (SELECT doc_id, len(p) np, len(g) ng, len(list_intersect(p, g)) k FROM w), "
    "r AS (SELECT doc_id, CASE WHEN ng = 0 AND np > 0 THEN 0.0 WHEN np = 0 THEN 1.0 ELSE k / np END pr, CASE WHEN ng = 0 THEN 1.0 ELSE k / ng END re, np, ng FROM s) "
    "SELECT doc_id, round(pr, 6)::DOUBLE AS precision_, round(re, 6)::DOUBLE AS recall, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6)::DOUBLE f1 FROM r",
)
def _(spark, root):
    d = docs(spark, root, "text", "lang").where("text IS NOT NULL")
    a = d.where("lang = 'en'").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("p"), (F.col("doc_id") + 1).alias("other"))
    b = d.select(F.col("doc_id").alias("other"), F.split(F.lower("text"), "[^a-z]+").alias("g"))
    pr, re, f1 = E.set_scores(F.col("p"), F.col("g"))
    return a.join(b, "other").select("doc_id", F.round(pr, 6).alias("precision_"), F.round(re, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query(
    "agg_06_substring_recall",
    "WITH g AS (SELECT target_language, list(DISTINCT lower(translation)) gold FROM glossary_entries GROUP BY 1), r AS (SELECT result_id, lower(text) t, target_language FROM (" + _RES + "SELECT * FROM res) WHERE text IS NOT NULL) "
    "SELECT result_id, round(len(list_filter(gold, lambda x: contains(t, x) OR contains(x, t))) / len(gold), 6)::DOUBLE recall FROM r JOIN g USING (target_language)",
)
def _(spark, root):
    g = table(spark, root, "glossary_entries", "translation", "target_language").groupBy("target_language").agg(F.collect_set(F.lower("translation")).alias("gold"))
    r = results(spark, root, "text", "target_language").where("text IS NOT NULL")
    return r.join(F.broadcast(g), "target_language").select("result_id", F.round(E.substring_recall(F.array("text"), F.col("gold")), 6).alias("recall"))


@query(
    "agg_07_pair_order",
    "SELECT doc_id, (CASE WHEN instr(lower(text), 'table') > 0 AND instr(lower(text), 'table') < instr(lower(text), 'group') THEN 0.5 ELSE 0 END + CASE WHEN instr(lower(text), 'the') > 0 AND instr(lower(text), 'the') < instr(lower(text), 'was') THEN 0.5 ELSE 0 END)::DOUBLE accuracy FROM documents WHERE text IS NOT NULL",
)
def _(spark, root):
    pairs = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in (("table", "group"), ("the", "was"))])
    return docs(spark, root, "text").where("text IS NOT NULL").select("doc_id", E.pair_order(F.col("text"), pairs).alias("accuracy"))


@query(
    "agg_08_relation_recall",
    "SELECT l_shipmode_year AS period, round(avg(hit), 6) recall FROM (SELECT year(o_orderdate) l_shipmode_year, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') THEN 1.0 ELSE 0.0 END hit FROM orders o) GROUP BY 1",
)
def _(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_orderdate").select(F.year("o_orderdate").alias("period"), "o_orderkey")
    p = table(spark, root, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(o, "o_orderkey")
    return E.relation_recall(p, o, ["o_orderkey"], "period").withColumn("recall", F.round("recall", 6))


@query("agg_09_error_rate", "SELECT a.p_partkey, round(CASE WHEN length(b.p_name) = 0 THEN 0 ELSE levenshtein(a.p_name, b.p_name) / length(b.p_name) END, 6)::DOUBLE cer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("gold"))
    return p.join(b, "p_partkey").select("p_partkey", F.round(E.error_rate(F.col("p_name"), F.col("gold")), 6).alias("cer"))


CATEGORIES = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN block_role IN ('heading', 'caption', 'reference', 'footnote', 'list') THEN block_role WHEN length(text) < 80 THEN 'short' ELSE 'body' END"


@query(
    "audit_rates",
    _BLK + f"SELECT {CATEGORIES} category, producer, count(*) n, round(count(*) FILTER (extraction_confidence >= 0.9) / count(*), 6)::DOUBLE high, round(count(*) FILTER (extraction_confidence < 0.7) / count(*), 6)::DOUBLE low, "
    "round(count(*) FILTER (deleted_at IS NOT NULL) / count(*), 6)::DOUBLE deleted FROM blk GROUP BY GROUPING SETS ((category, producer), (category), ())",
)
def audit_rates(spark, root):
    """Audit rates by source category and producer, one pass over grouping sets (the flagship)."""
    b = blocks(spark, root, "block_role", "text", "producer", "extraction_confidence", "deleted_at").withColumn("category", F.expr(CATEGORIES))
    flags = {"high": F.col("extraction_confidence") >= 0.9, "low": F.col("extraction_confidence") < 0.7, "deleted": F.col("deleted_at").isNotNull()}
    return E.rates(b, flags, [["category", "producer"], ["category"], []])


@query(
    "aud_02_stratified",
    _BLK + f"SELECT paper_id, block_id, stratum FROM (SELECT paper_id, block_id, {CATEGORIES} stratum, row_number() OVER (PARTITION BY {CATEGORIES} ORDER BY paper_id, block_order, block_id) k FROM blk) WHERE k <= 20",
)
def _(spark, root):
    b = blocks(spark, root, "block_role", "text", "block_order")
    return E.stratified(b, F.expr(CATEGORIES), ["paper_id", "block_order", "block_id"], 20).select("paper_id", "block_id", "stratum")


@query(
    "aud_06_review_merge",
    _RES + ", s AS (SELECT task_id, attempt, arg_min(text, result_id) old, arg_max(text, result_id) AS new FROM res GROUP BY 1, 2) SELECT count(*) n, count(*) FILTER (old IS NOT DISTINCT FROM new) n_kept FROM s",
)
def _(spark, root):
    r = results(spark, root, "task_id", "attempt", "text")
    key = F.concat_ws(":", "task_id", "attempt")
    g = r.groupBy(key.alias("key")).agg(F.min_by("text", "result_id").alias("old"), F.max_by("text", "result_id").alias("new"))
    queue, _gone = E.review_merge(g.select("key", F.col("new").alias("translation")), g.select("key", F.col("old").alias("translation"), F.lit("seen").alias("labels")), "key")
    return queue.agg(F.count("*").alias("n"), F.count("labels").alias("n_kept"))


@query(
    "aud_07_rates",
    _RES + "SELECT r.source_language, r.target_language, model, via, count(*) n, round(count(*) FILTER (text IS NULL) / greatest(count(*), 1), 6)::DOUBLE missing, round(count(*) FILTER (trim(text) = '') / greatest(count(*), 1), 6)::DOUBLE blank, round(count(*) FILTER (text = upper(text)) / greatest(count(*), 1), 6)::DOUBLE upper_, round(count(*) FILTER (output_chars < input_chars * 0.28) / greatest(count(*), 1), 6)::DOUBLE short, round(count(*) FILTER (output_chars > input_chars * 4) / greatest(count(*), 1), 6)::DOUBLE long_, round(count(*) FILTER (text = source_text) / greatest(count(*), 1), 6)::DOUBLE copied, round(count(*) FILTER (contains(text, chr(65533))) / greatest(count(*), 1), 6)::DOUBLE broken, round(count(*) FILTER (length(replace(text, '(', '')) <> length(replace(text, ')', ''))) / greatest(count(*), 1), 6)::DOUBLE brackets, round(count(*) FILTER (regexp_matches(source_text, '[0-9]') AND NOT regexp_matches(text, '[0-9]')) / greatest(count(*), 1), 6)::DOUBLE figures_lost, round(count(*) FILTER (output_chars <> length(text)) / greatest(count(*), 1), 6)::DOUBLE recounted, round(count(*) FILTER (attempt > 1) / greatest(count(*), 1), 6)::DOUBLE again, round(count(*) FILTER (output_tokens IS NULL) / greatest(count(*), 1), 6)::DOUBLE uncounted "
    "FROM res r LEFT JOIN (SELECT task_id, text source_text FROM translation_tasks) USING (task_id) GROUP BY GROUPING SETS ((r.source_language, r.target_language), (model), (via), ())",
)
def _(spark, root):
    r = results(spark, root, "task_id", "attempt", "via", "source_language", "target_language", "model", "text", "output_chars", "input_chars", "output_tokens")
    r = r.join(table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text"), "task_id", "left")
    flags = {
        "missing": F.col("text").isNull(),
        "blank": F.trim("text") == "",
        "upper_": F.col("text") == F.upper("text"),
        "short": F.col("output_chars") < F.col("input_chars") * 0.28,
        "long_": F.col("output_chars") > F.col("input_chars") * 4,
        "copied": F.col("text") == F.col("source_text"),
        "broken": F.contains("text", F.lit("\ufffd")),
        "brackets": F.length(F.replace("text", F.lit("("))) != F.length(F.replace("text", F.lit(")"))),
        "figures_lost": F.col("source_text").rlike("[0-9]") & ~F.col("text").rlike("[0-9]"),
        "recounted": F.col("output_chars") != F.length("text"),
        "again": F.col("attempt") > 1,
        "uncounted": F.col("output_tokens").isNull(),
    }
    return E.rates(r, flags, [["source_language", "target_language"], ["model"], ["via"], []])


@query(
    "aud_09_coverage",
    "WITH s AS (SELECT vec_id item, label AS k, embedding v FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id item, label AS k, embedding v FROM embeddings WHERE vec_id % 2 = 1), "
    "p AS (SELECT s.k, s.item si, t.item ti, list_cosine_similarity(s.v::DOUBLE[], t.v::DOUBLE[]) c FROM s JOIN t ON s.k = t.k), b AS (SELECT k, si, max(c) best FROM p GROUP BY 1, 2), g AS (SELECT k, ti, max(c) best FROM p GROUP BY 1, 2) "
    "SELECT label, least, mean, target_least, target_mean FROM (SELECT k AS label, round(min(best), 6) least, round(avg(best), 6) mean FROM b GROUP BY 1) JOIN (SELECT k AS label, round(min(best), 6) target_least, round(avg(best), 6) target_mean FROM g GROUP BY 1) USING (label)",
)
def _(spark, root):
    e = table(spark, root, "embeddings", "vec_id", "label", "embedding").withColumnRenamed("vec_id", "item")
    return E.coverage(e.where("item % 2 = 0"), e.where("item % 2 = 1"), "label", "embedding")


@query(
    "aud_11_run_summary",
    _RES + "SELECT model, median(translation_time_ms)::DOUBLE ms, round(sum(len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?'))), 6)::BIGINT numbers FROM res GROUP BY 1",
)
def _(spark, root):
    r = results(spark, root, "model", "translation_time_ms", "text")
    return r.groupBy("model").agg(F.median("translation_time_ms").alias("ms"), F.sum(F.regexp_count("text", F.lit(r"[0-9]+(\.[0-9]+)?"))).cast("long").alias("numbers"))


@query(
    "aud_12_throughput",
    _RES + "SELECT result_id, round(CASE WHEN translation_time_ms > 0 THEN output_chars / (translation_time_ms / 1000) ELSE 0.0 END, 4) chars_s, round(CASE WHEN translation_time_ms > 0 THEN output_tokens / (translation_time_ms / 1000) END, 4) tokens_s FROM res",
)
def _(spark, root):
    r = results(spark, root, "output_chars", "output_tokens", "translation_time_ms")
    ms = F.col("translation_time_ms")
    return r.select("result_id", F.round(E.per_second(F.col("output_chars"), ms, 0.0), 4).alias("chars_s"), F.round(E.per_second(F.col("output_tokens"), ms, None), 4).alias("tokens_s"))
