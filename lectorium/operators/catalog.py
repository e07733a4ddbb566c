"""Catalog and bookkeeping helpers: pending work, projections, write-through, term repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(listed: DataFrame, cached: DataFrame, complete: DataFrame, key: str) -> DataFrame:
    """Listed items that are cached and not complete."""
    return listed.join(cached.select(key).distinct(), key, "left_semi").join(complete.select(key).distinct(), key, "left_anti")


def usable_download(size: Column, head: Column, least: int = 8000) -> Column:
    """A PDF of some size: the rest of a broken transfer is refused."""
    return (size >= least) & head.startswith("%PDF")


def pdf_name(c: Column) -> Column:
    return F.lower(F.trim(c)).endswith(".pdf")


def open_error(message: Column) -> Column:
    """Class of an opening error."""
    m = F.lower(message)
    return F.when(m.rlike("password|encrypt"), "encrypted").when(m.rlike("invalid pdf|missing pdf|corrupt"), "invalid").when(m.rlike("network|fetch|timeout"), "network").otherwise("unknown")


def projected_authors(papers: DataFrame) -> DataFrame:
    """One row per author with a synthetic id by place."""
    d = papers.select("id", F.posexplode("authors").alias("ord", "name"))
    return d.select("id", F.concat(F.col("id"), F.lit("-a"), F.col("ord").cast("string")).alias("author_id"), "ord", "name")


def visible(blocks: DataFrame) -> DataFrame:
    """Blocks that are content: no headings, no figures without text."""
    return blocks.where(~F.col("block_role").isin("heading") & F.col("text").isNotNull())


def written_through(positions: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers with the last position's block and time.  positions: paper_id, block_id, updated_at."""
    last = positions.groupBy("paper_id").agg(F.max_by("block_id", F.struct("updated_at", "block_id")).alias("last_block"), F.max("updated_at").alias("last_read"))
    return papers.join(last.withColumnRenamed("paper_id", "id"), "id", "left")


def structure_edges(blocks: DataFrame) -> DataFrame:
    """READS_BEFORE between neighbours that are no headings, CHILD_OF from blocks to their section."""
    w = Window.partitionBy("paper_id").orderBy("block_order", "block_id")
    section = F.last(F.when(F.col("block_role") == "heading", F.col("block_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = blocks.withColumn("_sec", section).where("block_role <> 'heading'")
    reads = b.select("paper_id", F.lit("READS_BEFORE").alias("type"), F.col("block_id").alias("source"), F.lead("block_id").over(w).alias("target")).where("target IS NOT NULL")
    return reads.unionByName(b.where("_sec IS NOT NULL").select("paper_id", F.lit("CHILD_OF").alias("type"), F.col("block_id").alias("source"), F.col("_sec").alias("target")))


def rejoined(structure: DataFrame, texts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Structure rows with the first text that any of the sources has, in their order."""
    d, cols = structure, []
    for i, t in enumerate(texts):
        d = d.join(t.select(*key, F.col("text").alias(f"_t{i}")), list(key), "left")
        cols.append(F.when(F.col(f"_t{i}") != "", F.col(f"_t{i}")))
    return d.withColumn("text", F.coalesce(*cols)).drop(*[f"_t{i}" for i in range(len(texts))])


def repaired_terms(source: Column, output: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Fold of rules (source pattern, output pattern, replacement): each holds only where the source has its term."""
    for has, find, put in rules:
        output = F.when(source.rlike(has), F.regexp_replace(output, find, put)).otherwise(output)
    return output


def imported(base: DataFrame, legacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-if-absent, twice gives the same."""
    return base.unionByName(legacy.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti"))


def gold_report(predicted: DataFrame, gold: DataFrame, key: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per key; a metric is null where its gold is not annotated.  metrics: name to (value, gold array)."""
    d = gold.join(predicted, key, "left")
    return d.select(key, *[F.when(F.size(g) > 0, v).alias(n) for n, (v, g) in metrics.items()])
