"""Merge, reconcile, validate and migrate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.operators import merge as M
from lectorium.operators.versions import latest
from lectorium.plans.library import _ANN, _BLK, _CUR, blocks, notes
from lectorium.plans.registry import query
from lectorium.sources.tables import table

_TWO = (
    "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at, coalesce(text, '')) k FROM layout_blocks) WHERE k = 1), "
    "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at DESC, coalesce(text, '') DESC) k FROM layout_blocks) WHERE k = 1) "
)
_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(
    "mrg_01_prefer_filled",
    "WITH o AS (SELECT task_id, arg_min(text, result_id) AS text FROM (SELECT DISTINCT task_id, result_id, text FROM translation_results WHERE attempt = 1) GROUP BY 1), "
    "n AS (SELECT task_id, first(text ORDER BY result_id DESC) AS text FROM (SELECT DISTINCT task_id, result_id, text FROM translation_results WHERE attempt > 1) GROUP BY 1) "
    "SELECT coalesce(o.task_id, n.task_id) task_id, CASE WHEN n.task_id IS NULL OR (coalesce(o.text, '') <> '' AND coalesce(n.text, '') = '') THEN o.text ELSE n.text END AS text FROM o FULL JOIN n ON o.task_id = n.task_id",
)
def _(spark, root):
    r = latest(table(spark, root, "translation_results", "result_id", "task_id", "attempt", "text", "ingested_at"), ["result_id"], ["ingested_at"])
    o = r.where("attempt = 1 AND text IS NOT NULL").groupBy("task_id").agg(F.min_by("text", "result_id").alias("text"))
    n = r.where("attempt > 1").groupBy("task_id").agg(F.max_by("text", "result_id").alias("text"))
    return M.prefer_filled(r.where("attempt = 1").select("task_id").distinct().join(o, "task_id", "left"), n, ["task_id"], "text")


@query(
    "mrg_03_patch",
    "SELECT coalesce(c.c_custkey, p.k) c_custkey, coalesce(p.seg, c.c_mktsegment) c_mktsegment FROM customer c FULL JOIN (SELECT o_custkey k, max(o_orderpriority) seg FROM orders WHERE o_totalprice > 200000 GROUP BY 1) p ON c.c_custkey = p.k",
)
def _(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    p = table(spark, root, "orders", "o_custkey", "o_orderpriority", "o_totalprice").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return M.patched(c, p, ["c_custkey"])


@query("mrg_04_last_update", "SELECT user_id, event_type, arg_max(event_id, ts) event_id, max(ts) ts FROM events GROUP BY 1, 2")
def _(spark, root):
    return M.coalesced_updates(table(spark, root, "events", "event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts")


def _snapshots(spark, root):
    """The first and the last version of each block, in one row where they are the same."""
    b = table(spark, root, "layout_blocks", "paper_id", "block_id", "block_role", "page_start", "text", "column_side", "bbox", "updated_at")
    s = F.struct(F.col("block_role").alias("kind"), F.col("page_start").alias("page"), "text", F.col("column_side").alias("section"), F.col("bbox.page").alias("box_page"), F.col("bbox.x_left").alias("x"), F.col("bbox.y_top").alias("y"))
    at = F.struct("updated_at", F.coalesce("text", F.lit("")))
    g = b.groupBy("paper_id", "block_id").agg(F.min_by(s, at).alias("f"), F.max_by(s, at).alias("l"))
    side = lambda c, n: F.struct(F.col(c).alias("v"), F.lit(n).alias("side"))
    v = F.explode(F.when(F.col("f") == F.col("l"), F.array(side("f", 3))).otherwise(F.array(side("f", 1), side("l", 2))))
    return g.select("paper_id", F.col("block_id").alias("id"), v.alias("r")).select("paper_id", "id", "r.v.*", "r.side")


def _reconciled(spark, root):
    return M.reconciled_blocks(_snapshots(spark, root), "paper_id").withColumn("n_id", F.concat(F.lit("n-"), "n_id"))


@query(
    "rec_01_pair_scores",
    _TWO + ", o AS (SELECT *, coalesce(" + _NORM + ", '') t FROM f), n AS (SELECT *, coalesce(" + _NORM + ", '') t FROM l), p AS (SELECT o.paper_id, o.block_id o_id, (o.page_start = n.page_start) same_page, (CASE WHEN o.block_role = n.block_role THEN 2 ELSE 0 END + CASE WHEN o.page_start = n.page_start THEN 2 ELSE 0 END "
    "+ CASE WHEN o.t = '' OR n.t = '' THEN 0 WHEN o.t = n.t THEN 8 WHEN contains(o.t, n.t) OR contains(n.t, o.t) THEN 4 ELSE 0 END + CASE WHEN o.column_side <> '' AND o.column_side = n.column_side THEN 1 ELSE 0 END "
    "+ CASE WHEN o.bbox.page = n.bbox.page AND abs(o.bbox.x_left - n.bbox.x_left) < 12 AND abs(o.bbox.y_top - n.bbox.y_top) < 12 THEN 3 ELSE 0 END)::INT score FROM o JOIN n ON o.paper_id = n.paper_id), q AS (SELECT * FROM p WHERE score >= 6) "
    "SELECT score, count(*) n, count(DISTINCT o_id) n_old FROM q GROUP BY 1",
)
def _(spark, root):
    p = M.scored_pairs(_snapshots(spark, root), "paper_id")
    return p.groupBy("score").agg(F.count("*").alias("n"), F.countDistinct("o_id").alias("n_old"))


@query("rec_02_reconciled")
def _(spark, root):
    return _reconciled(spark, root)


@query("rec_03_remapped")
def _(spark, root):
    m = _reconciled(spark, root)
    return M.remapped(notes(spark, root, "paper_id", "block_id"), m, ["paper_id"], "block_id").select("id", "paper_id", "block_id")


@query("rec_03_positions")
def _(spark, root):
    """The last read block of each paper under its new id."""
    m = _reconciled(spark, root)
    last = notes(spark, root, "paper_id", "block_id", "updated_at").groupBy("paper_id").agg(F.max_by("block_id", F.struct("updated_at", "id")).alias("block_id"))
    return M.remapped(last, m, ["paper_id"], "block_id").select("paper_id", "block_id")


@query(
    "val_01_violations",
    _BLK + ", " + _ANN + ", v AS (SELECT 'DUPLICATE_BLOCK_ORDER' code, 'error' severity, paper_id doc, block_order::VARCHAR item FROM blk GROUP BY paper_id, block_order HAVING count(*) > 1 "
    "UNION ALL SELECT 'MISSING_TEXT', 'warning', paper_id, block_id FROM blk WHERE text IS NULL AND block_role <> 'figure' "
    "UNION ALL SELECT 'PAGE_RANGE', 'error', paper_id, block_id FROM blk WHERE page_start < 1 OR page_end < page_start "
    "UNION ALL SELECT 'BOX', 'error', paper_id, block_id FROM blk WHERE NOT (bbox.width > 0 AND bbox.height > 0 AND bbox.x_left >= 0 AND bbox.y_top >= 0) "
    "UNION ALL SELECT 'BOX_PAGE', 'warning', paper_id, block_id FROM blk WHERE NOT bbox.page BETWEEN page_start AND page_end "
    "UNION ALL SELECT DISTINCT 'ANNOTATION_BLOCK', 'error', paper_id, block_id FROM ann a WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.paper_id = a.paper_id AND blk.block_id = a.block_id) "
    "UNION ALL SELECT 'OFFSETS', 'error', paper_id, id FROM ann WHERE end_offset < start_offset) SELECT * FROM v",
)
def _(spark, root):
    b = blocks(spark, root, "block_order", "block_role", "text", "page_start", "page_end", "bbox")
    return M.violations({"blocks": b, "annotations": notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset")}, M.package_rules())


@query(
    "val_01_library",
    _BLK + ", " + _ANN + ", " + _CUR.replace("WITH ", "", 1) + ", rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) rn FROM translation_results) WHERE rn = 1), "
    "ab AS (SELECT a.*, b.text FROM ann a JOIN blk b USING (paper_id, block_id)), v AS (SELECT DISTINCT 'UNKNOWN_PAPER' code, 'error' severity, paper_id doc, paper_id item FROM blk WHERE paper_id NOT IN (SELECT id FROM cur) "
    "UNION ALL SELECT 'EMPTY_PAPER', 'warning', id, id FROM cur WHERE id NOT IN (SELECT paper_id FROM blk) "
    "UNION ALL SELECT 'PAGE_COUNT', 'error', paper_id, block_id FROM blk JOIN cur ON blk.paper_id = cur.id WHERE page_end > page_count "
    "UNION ALL SELECT 'REVISION', 'error', id, id FROM cur WHERE package_revision < 0 "
    "UNION ALL SELECT DISTINCT 'TASK_BLOCK', 'warning', paper_id, block_id FROM translation_tasks t WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.paper_id = t.paper_id AND blk.block_id = t.block_id) "
    "UNION ALL SELECT 'RESULT_TASK', 'error', result_id::VARCHAR, task_id::VARCHAR FROM rs WHERE task_id NOT IN (SELECT task_id FROM translation_tasks) "
    "UNION ALL SELECT 'OFFSET_BEYOND', 'error', paper_id, id FROM ab WHERE end_offset > length(text) "
    "UNION ALL SELECT 'SELECTION', 'warning', paper_id, id FROM ab WHERE substring(text, start_offset + 1, end_offset - start_offset) <> selected_text "
    "UNION ALL SELECT 'BLANK_HEADING', 'warning', paper_id, block_id FROM blk WHERE block_role = 'heading' AND trim(text) = '') SELECT * FROM v",
)
def _(spark, root):
    from lectorium.plans.library import current, results

    tables = {
        "blocks": blocks(spark, root, "block_role", "text", "page_end"),
        "annotations": notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset", "selected_text"),
        "papers": current(spark, root, "page_count", "package_revision"),
        "tasks": table(spark, root, "translation_tasks", "task_id", "paper_id", "block_id"),
        "results": results(spark, root, "task_id"),
    }
    return M.violations(tables, M.library_rules())


@query("mig_02_dedup", _CUR + "SELECT id FROM cur WHERE id IN (SELECT min(id) FROM cur GROUP BY source_file_hash)")
def _(spark, root):
    from lectorium.plans.library import current

    return M.deduped(current(spark, root, "source_file_hash"), "source_file_hash", "id").select("id")


@query("mig_04_columns", "SELECT n_nationkey, n_name, 'eur' AS currency, 0 AS revision FROM nation")
def _(spark, root):
    steps = {2: lambda d: M.with_columns(d, {"currency": F.lit("eur")}), 3: lambda d: M.with_columns(d, {"revision": F.lit(0)})}
    return M.migrated(table(spark, root, "nation", "n_nationkey", "n_name"), 1, steps)


@query("mig_06_stale", _CUR + ", i AS (SELECT id, min(package_revision) r FROM papers GROUP BY 1) SELECT cur.id FROM cur JOIN i USING (id) WHERE cur.package_revision <> i.r")
def _(spark, root):
    from lectorium.plans.library import current

    p = table(spark, root, "papers", "id", "package_revision").groupBy("id").agg(F.min("package_revision").alias("revision"))
    return M.stale(p, current(spark, root, "package_revision").withColumnRenamed("package_revision", "revision"), "id")
