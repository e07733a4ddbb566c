"""Library queries and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lectorium.operators import library as L
from lectorium.operators.versions import latest
from lectorium.plans.registry import query
from lectorium.sources.tables import table

_CUR = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) rn FROM papers) WHERE rn = 1 AND deleted_at IS NULL) "
_BLK = "WITH blk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at DESC) rn FROM layout_blocks) WHERE rn = 1) "
_RES = "WITH res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) rn FROM translation_results) WHERE rn = 1) "
_ANN = "ann AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) rn FROM annotations) WHERE rn = 1) "


def current(spark, root, *cols):
    want = dict.fromkeys(["id", "updated_at", "deleted_at", *cols])
    return L.current_papers(table(spark, root, "papers", *want))


def blocks(spark, root, *cols):
    want = dict.fromkeys(["paper_id", "block_id", "updated_at", *cols])
    return latest(table(spark, root, "layout_blocks", *want), ["paper_id", "block_id"], ["updated_at"])


def results(spark, root, *cols):
    want = dict.fromkeys(["result_id", "ingested_at", *cols])
    return latest(table(spark, root, "translation_results", *want), ["result_id"], ["ingested_at"])


def notes(spark, root, *cols):
    want = dict.fromkeys(["id", "ingested_at", *cols])
    return latest(table(spark, root, "annotations", *want), ["id"], ["ingested_at"])


@query("lib_01_point_lookup", "SELECT line_id, paper_id, page, line_no, text FROM page_lines WHERE paper_id = 'p-0000hotvol' AND origin = 'ocr'")
def _(spark, root):
    return L.by_key(table(spark, root, "page_lines", "line_id", "paper_id", "page", "line_no", "text", "origin"), paper_id="p-0000hotvol", origin="ocr").drop("origin")


@query("lib_02_import_gate", _CUR + "SELECT id, source_file_hash FROM (SELECT id, source_file_hash, row_number() OVER (PARTITION BY source_file_hash ORDER BY created_at, id) k FROM cur) WHERE k > 1")
def _(spark, root):
    return L.duplicates_of(current(spark, root, "source_file_hash", "created_at")).select("id", "source_file_hash")


@query("lib_03_newest", _CUR + "SELECT id, title_original, updated_at FROM cur ORDER BY updated_at DESC, id")
def _(spark, root):
    return current(spark, root, "title_original").select("id", "title_original", "updated_at").orderBy(F.desc("updated_at"), "id")


_TEXT = "lower(concat_ws(' ', nullif(title_original, ''), nullif(title_translated, ''), nullif(source_file_name, ''), nullif(publication, ''), array_to_string(authors, ' ')))"


@query("lib_04_text_filter", _CUR + f"SELECT id, title_original FROM cur WHERE contains({_TEXT}, 'wage')")
def _(spark, root):
    return L.matching(current(spark, root, "title_original", "title_translated", "source_file_name", "publication", "authors"), " Wage ").select("id", "title_original")


@query("lib_05_favorites", _CUR + f"SELECT id, title_original FROM cur WHERE favorite AND contains({_TEXT}, 'an')")
def _(spark, root):
    p = current(spark, root, "title_original", "title_translated", "source_file_name", "publication", "authors", "favorite")
    return L.matching(p.where("favorite"), "an").select("id", "title_original")


@query("lib_06_recent", _CUR + f"SELECT id, last_opened_at FROM (SELECT * FROM cur WHERE last_opened_at IS NOT NULL ORDER BY last_opened_at DESC, id LIMIT 30) WHERE contains({_TEXT}, 'a')")
def _(spark, root):
    p = current(spark, root, "title_original", "title_translated", "source_file_name", "publication", "authors", "last_opened_at")
    return L.recent(p, "a").select("id", "last_opened_at")


@query("lib_07_continue_reading", _CUR + "SELECT id, last_opened_at FROM cur WHERE last_opened_at IS NOT NULL ORDER BY last_opened_at DESC, id LIMIT 3")
def _(spark, root):
    return L.continue_reading(current(spark, root, "last_opened_at")).select("id", "last_opened_at")


@query("lib_08_inbox", _CUR + "SELECT id FROM cur WHERE NOT EXISTS (SELECT 1 FROM workspace_papers w WHERE lower(trim(w.paper_id)) = cur.id)")
def _(spark, root):
    return L.inbox(current(spark, root), table(spark, root, "workspace_papers", "paper_id")).select("id")


@query("lib_12_memberships", "SELECT DISTINCT node_id, paper_id, sort_order FROM workspace_papers WHERE node_id IN (SELECT node_id FROM workspace_papers GROUP BY 1 HAVING count(*) > 2)")
def _(spark, root):
    w = table(spark, root, "workspace_papers", "node_id", "paper_id", "sort_order")
    busy = w.groupBy("node_id").count().where("count > 2").select("node_id")
    return w.join(busy, "node_id", "left_semi").distinct()


@query(
    "lib_14_annotation_order",
    _BLK + ", " + _ANN + "SELECT id, paper_id, coalesce(b.block_order, 2147483647) block_order, row_number() OVER (PARTITION BY a.paper_id ORDER BY coalesce(b.block_order, 2147483647), start_offset, id) place "
    "FROM ann a LEFT JOIN blk b USING (paper_id, block_id)",
)
def _(spark, root):
    return L.annotations_in_order(notes(spark, root, "paper_id", "block_id", "start_offset"), blocks(spark, root, "block_order")).select("id", "paper_id", "block_order", "place")


@query("lib_15_facts", _RES + "SELECT model, count(*) n, count(text) n_text, round(sum(translation_time_ms), 2) ms, min(completed_at) first_at, max(completed_at) last_at FROM res GROUP BY 1")
def _(spark, root):
    r = results(spark, root, "model", "text", "translation_time_ms", "completed_at")
    return r.groupBy("model").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.round(F.sum("translation_time_ms"), 2).alias("ms"), F.min("completed_at").alias("first_at"), F.max("completed_at").alias("last_at"))


_KEYS = ["text_hash", "model", "model_version", "source_language", "target_language"]


@query(
    "lib_16_cache_probe",
    "WITH req AS (SELECT DISTINCT sha256(text) text_hash, source_language, target_language, m.model, m.model_version FROM translation_tasks, (SELECT DISTINCT model, model_version FROM translation_cache) m), "
    "c AS (SELECT text_hash, model, model_version, source_language, target_language, max(cached_at) cached_at FROM translation_cache GROUP BY ALL) "
    "SELECT model, model_version, count(*) n_requests, count(cached_at) n_hits FROM req LEFT JOIN c USING (text_hash, model, model_version, source_language, target_language) GROUP BY 1, 2",
)
def _(spark, root):
    cache = table(spark, root, "translation_cache", *_KEYS, "translated_text", "cached_at")
    models = cache.select("model", "model_version").distinct()
    tasks = table(spark, root, "translation_tasks", "text", "source_language", "target_language").select(F.sha2("text", 256).alias("text_hash"), "source_language", "target_language").distinct()
    # one request per known model: a short list, taken from the cache first
    known = models.orderBy("model", "model_version").limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("the models are a short list")
    each = F.array(*[F.struct(F.lit(m.model).alias("model"), F.lit(m.model_version).alias("model_version")) for m in known])
    req = tasks.select("*", F.inline(each))
    hit = L.cache_probe(req, cache, _KEYS)
    return hit.groupBy("model", "model_version").agg(F.count("*").alias("n_requests"), F.count("cached_at").alias("n_hits"))


@query("lib_17_cache_clear", "SELECT count(*) FILTER (model = 'kuroshio-3b') n_cleared FROM translation_cache")
def _(spark, root):
    return L.cleared(table(spark, root, "translation_cache", "model"), "kuroshio-3b")[1]


@query(
    "lib_18_upsert",
    "WITH delta AS (SELECT o_orderkey, o_totalprice * 2 o_totalprice, o_orderdate + INTERVAL 1 DAY o_orderdate FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey + 100000000, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P') "
    "SELECT coalesce(d.o_orderkey, o.o_orderkey) o_orderkey, round(coalesce(d.o_totalprice, o.o_totalprice), 2) o_totalprice, coalesce(d.o_orderdate, o.o_orderdate) o_orderdate FROM orders o FULL JOIN delta d ON o.o_orderkey = d.o_orderkey",
)
def _(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    base = o.drop("o_orderstatus")
    delta = o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("o_orderdate"))
    delta = delta.unionByName(o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), "o_totalprice", "o_orderdate"))
    return L.upserted(base, delta, ["o_orderkey"], "o_orderdate").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("lib_19_cascade", "SELECT count(*) n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, root):
    doomed = table(spark, root, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'")
    return L.cascade_deleted(table(spark, root, "lineitem", "l_orderkey"), doomed, "l_orderkey", "o_orderkey").agg(F.count("*").alias("n"))


@query(
    "lib_21_progress",
    _BLK + ", " + _ANN + ", pos AS (SELECT paper_id, arg_max(block_id, (updated_at, id)) block_id FROM ann GROUP BY 1), "
    "pl AS (SELECT paper_id, block_id, row_number() OVER (PARTITION BY paper_id ORDER BY block_order, block_id) place, count(*) OVER (PARTITION BY paper_id) n FROM blk) "
    "SELECT paper_id, block_id, floor(100 * place / n + 0.5)::INT percent FROM pos LEFT JOIN pl USING (paper_id, block_id)",
)
def _(spark, root):
    pos = notes(spark, root, "paper_id", "block_id", "updated_at").groupBy("paper_id").agg(F.max_by("block_id", F.struct("updated_at", "id")).alias("block_id"))
    return L.progress(blocks(spark, root, "block_order"), pos).select("paper_id", "block_id", "percent")


@query(
    "lib_25_day_label",
    _CUR + "SELECT id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days' ELSE strftime(last_opened_at, '%Y-%m-%d') END label "
    "FROM (SELECT id, last_opened_at, date_diff('day', last_opened_at::DATE, DATE '2025-06-30') d FROM cur WHERE last_opened_at IS NOT NULL)",
)
def _(spark, root):
    return current(spark, root, "last_opened_at").where("last_opened_at IS NOT NULL").select("id", L.day_label(F.col("last_opened_at"), datetime(2025, 6, 30)).alias("label"))


@query("lib_27_display_title", _CUR + "SELECT id, coalesce(nullif(trim(title_translated), ''), nullif(trim(title_original), ''), nullif(trim(source_file_name), ''), '(untitled)') title FROM cur")
def _(spark, root):
    return current(spark, root, "title_original", "title_translated", "source_file_name").select("id", L.display_title(F.col("title_translated"), F.col("title_original"), F.col("source_file_name")).alias("title"))


@query("hlp_07_only_membership", "SELECT paper_id, min(node_id) node_id FROM workspace_papers GROUP BY 1 HAVING count(DISTINCT node_id) = 1")
def _(spark, root):
    return L.only_membership(table(spark, root, "workspace_papers", "node_id", "paper_id"))
