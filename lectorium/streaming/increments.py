"""Incremental work: queues, cache before compute, micro-batches, event-time windows.

Streams are Structured Streaming throughout; the batch forms of the same operators take static frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectorium.operators.ordered import with_place

# Priority levels, the most urgent first.
CRITICAL, HIGH, MEDIUM, LOW = 0, 1, 2, 3


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8, name: str = "*.parquet") -> DataFrame:
    """A directory of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(path)


def priority_from_focus(offset: Column) -> Column:
    """Level by distance to the reading focus: behind it low, next critical, then by steps."""
    return F.when(offset < 0, LOW).when(offset <= 1, CRITICAL).when(offset <= 3, HIGH).when(offset <= 5, MEDIUM).otherwise(LOW)


def around_focus(blocks: DataFrame, focus: DataFrame) -> DataFrame:
    """Each block of a paper with its priority around the paper's focus block."""
    b = with_place(blocks, ["paper_id"], ["block_order", "block_id"], "_at")
    f = b.join(focus.select("paper_id", "block_id"), ["paper_id", "block_id"]).select("paper_id", F.col("_at").alias("_focus"))
    return b.join(f, "paper_id").withColumn("priority", priority_from_focus(F.col("_at") - F.col("_focus"))).drop("_at", "_focus")


def queue_order(tasks: DataFrame) -> DataFrame:
    """Place in the queue of each language pair: by priority, then first in first out."""
    return with_place(tasks, ["source_language", "target_language"], ["priority", "queued_at", "task_id"])


def reprioritized(tasks: DataFrame, levels: DataFrame) -> DataFrame:
    """New priorities (paper_id, block_id, priority) for tasks that still wait."""
    n = levels.select("paper_id", "block_id", F.col("priority").alias("_p"))
    return tasks.join(n, ["paper_id", "block_id"], "left").withColumn("priority", F.when((F.col("status") == "queued") & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("priority"))).drop("_p")


def cancelled(tasks: DataFrame, papers: DataFrame) -> DataFrame:
    return tasks.join(papers.select("paper_id"), "paper_id", "left_anti")


def micro_batches(tasks: DataFrame, at: str, milliseconds: int = 25) -> DataFrame:
    """Requests grouped by arrival window and language pair, with their place in the batch."""
    d = tasks.withColumn("window_start", F.window(at, f"{milliseconds} milliseconds")["start"])
    w = Window.partitionBy("window_start", "source_language", "target_language").orderBy(at, "task_id")
    return d.withColumn("place", F.row_number().over(w))


def cache_split(requests: DataFrame, cache: DataFrame, keys: list[str], usable: Callable[[Column], Column] = lambda c: c.isNotNull()) -> tuple[DataFrame, DataFrame]:
    """(hits with ``cached``, misses): only usable entries count as hits."""
    c = cache.where(usable(F.col("translated_text"))).groupBy(*keys).agg(F.max_by("translated_text", F.struct("cached_at", "translated_text")).alias("cached"))
    d = requests.join(c, keys, "left")
    return d.where("cached IS NOT NULL"), d.where("cached IS NULL").drop("cached")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, every: str, late: str, *by: str) -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are dropped.  An extension."""
    d = stream.withWatermark(at, late) if stream.isStreaming else stream
    return d.groupBy(F.window(at, every).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def into_table(stream: DataFrame, path: str, checkpoint: str, gate: Column | None = None, trigger_once: bool = True):
    """Append accepted rows per micro-batch; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        d = batch.where(gate) if gate is not None else batch
        d.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="25 milliseconds")).start()
