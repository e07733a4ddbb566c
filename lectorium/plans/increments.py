"""Queue, cache and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions import segments as G
from lectorium.plans.library import _BLK, blocks
from lectorium.plans.registry import query
from lectorium.session import own_folder, spread
from lectorium.sources.tables import table
from lectorium.streaming import increments as I


@query("stm_01_queue", "SELECT task_id, row_number() OVER (PARTITION BY source_language, target_language ORDER BY priority, queued_at, task_id) place FROM translation_tasks")
def _(spark, root):
    return I.queue_order(table(spark, root, "translation_tasks", "task_id", "source_language", "target_language", "priority", "queued_at")).select("task_id", "place")


@query(
    "stm_02_around_focus",
    _BLK + ", o AS (SELECT paper_id, block_id, row_number() OVER (PARTITION BY paper_id ORDER BY block_order, block_id) AS pos FROM blk), f AS (SELECT paper_id, pos FROM o JOIN (SELECT paper_id, min(block_id) block_id FROM blk GROUP BY 1) USING (paper_id, block_id)) "
    "SELECT o.paper_id, block_id, CASE WHEN d < 0 THEN 3 WHEN d <= 1 THEN 0 WHEN d <= 3 THEN 1 WHEN d <= 5 THEN 2 ELSE 3 END priority FROM (SELECT o.paper_id, block_id, o.pos - f.pos d FROM o JOIN f USING (paper_id)) o",
)
def _(spark, root):
    b = blocks(spark, root, "block_order")
    return I.around_focus(b, b.groupBy("paper_id").agg(F.min("block_id").alias("block_id"))).select("paper_id", "block_id", "priority")


@query("stm_04_cancelled", "SELECT task_id FROM translation_tasks WHERE paper_id NOT IN (SELECT paper_id FROM translation_tasks WHERE status = 'failed')")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "paper_id", "status")
    return I.cancelled(t, t.where("status = 'failed'").select("paper_id").distinct()).select("task_id")


@query(
    "stm_06_micro_batches",
    "SELECT task_id, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, queued_at), source_language, target_language ORDER BY queued_at, task_id) place FROM translation_tasks",
)
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "source_language", "target_language", "queued_at")
    return I.micro_batches(t, "queued_at", 3_600_000).select("task_id", "place")


_K = ["text_hash", "source_language", "target_language"]


@query(
    "stm_08_cache_split",
    "WITH r AS (SELECT task_id, sha256(text) text_hash, source_language, target_language FROM translation_tasks), c AS (SELECT DISTINCT text_hash, source_language, target_language, 1 hit FROM translation_cache WHERE translated_text IS NOT NULL) "
    "SELECT r.source_language, r.target_language, count(*) n, count(hit) n_hits FROM r LEFT JOIN c USING (text_hash, source_language, target_language) GROUP BY 1, 2",
)
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "text", "source_language", "target_language").select("task_id", F.sha2("text", 256).alias("text_hash"), "source_language", "target_language")
    hits, misses = I.cache_split(t, table(spark, root, "translation_cache", *_K, "translated_text", "cached_at"), _K)
    both = hits.select(*_K, F.lit(1).alias("hit")).unionByName(misses.select(*_K, F.lit(None).cast("int").alias("hit")))
    return both.groupBy("source_language", "target_language").agg(F.count("*").alias("n"), F.count("hit").alias("n_hits"))


@query("stm_09_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def _(spark, root):
    return I.windowed(table(spark, root, "events", "ts", "event_type", "value"), "ts", "1 hour", "1 day", "event_type")


@query("stm_12_stream_first", "SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2")
def _(spark, root):
    """events as a stream, one delivery per event id, appended per micro-batch and read back."""
    at = own_folder(spark, "stream")
    schema = table(spark, root, "events").schema
    s = I.first_deliveries(I.source(spark, root, schema, name="events.parquet").where("event_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "60 days")
    I.into_table(s, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("seg_01_units")
def _(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")
    return spread(d).select("doc_id", F.posexplode(G.units_column(F.col("text"))).alias("ix", "unit"))


@query("seg_08_round_trip", "SELECT count(*) n, 0 AS n_broken FROM documents WHERE trim(text) <> ''")
def _(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").where("trim(text) <> ''")
    plain = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    bad = plain(F.col("text")) != plain(F.concat_ws("", G.units_column(F.col("text"))))
    return d.agg(F.count("*").alias("n"), F.count_if(bad).cast("int").alias("n_broken"))


@query("inf_01_translated")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "task_id", "text", "source_language", "target_language")
    return G.translated(t).select("task_id", "output", "status", "error")
