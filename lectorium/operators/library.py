"""Relational library: filters, joins, top-k, upsert, cascade.

Every operator takes and gives DataFrames; orders carry a unique tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.text import contains_folded, filled
from lectorium.operators.ordered import with_place
from lectorium.operators.versions import latest


def current_papers(papers: DataFrame) -> DataFrame:
    """Latest version of each paper, deletions left out."""
    return latest(papers, ["id"], ["updated_at"]).where("deleted_at IS NULL")


def duplicates_of(papers: DataFrame, by: str = "source_file_hash") -> DataFrame:
    """Papers whose content hash is held by an earlier paper: what an import gate refuses."""
    first = papers.groupBy(by).agg(F.min(F.struct("created_at", "id")).alias("_f"))
    return papers.join(first, by).where(F.col("id") != F.col("_f.id")).drop("_f")


def library_text(*columns: str, arrays: Sequence[str] = ()) -> Column:
    """The text a free-text filter looks in; null and empty parts are dropped."""
    return F.concat_ws(" ", *[filled(F.col(c)) for c in columns], *[F.concat_ws(" ", F.col(a)) for a in arrays])


def matching(papers: DataFrame, needle: str, columns: Sequence[str] = ("title_original", "title_translated", "source_file_name", "publication"), arrays: Sequence[str] = ("authors",)) -> DataFrame:
    """Papers whose text contains the needle, case aside; a blank needle keeps all."""
    return papers.where(contains_folded(library_text(*columns, arrays=arrays), needle))


def recent(papers: DataFrame, needle: str = "", k: int = 30) -> DataFrame:
    """The k last opened papers, and of those the matching ones: top-k first, then the filter."""
    top = papers.where("last_opened_at IS NOT NULL").orderBy(F.desc(F.coalesce("last_opened_at", "updated_at")), "id").limit(k)
    return matching(top, needle)


def continue_reading(papers: DataFrame, k: int = 3) -> DataFrame:
    return papers.where("last_opened_at IS NOT NULL").orderBy(F.desc("last_opened_at"), "id").limit(k)


def inbox(papers: DataFrame, memberships: DataFrame) -> DataFrame:
    """Papers in no folder."""
    return papers.join(memberships.select(F.lower(F.trim("paper_id")).alias("id")), "id", "left_anti")


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Point lookup on one or more key columns; reaches the scan as a pushed filter."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def annotations_in_order(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Annotations with their place: order of the block (unknown blocks last), then offset, then id."""
    most = 2**31 - 1
    b = blocks.select("paper_id", "block_id", "block_order")
    d = annotations.join(b, ["paper_id", "block_id"], "left").withColumn("block_order", F.coalesce("block_order", F.lit(most)))
    return with_place(d, ["paper_id"], ["block_order", "start_offset", "id"])


def cache_probe(requests: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests with the cached value of the full key, newest entry first; misses have null."""
    c = latest(cache, list(keys), ["cached_at"], ["translated_text", "cached_at"])
    return requests.join(c, list(keys), "left")


def cleared(cache: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number of rows that go) for one model or all."""
    gone = F.lit(True) if model is None else F.col("model") == model
    return cache.where(~gone), cache.agg(F.count_if(gone).alias("n_cleared"))


def upserted(base: DataFrame, delta: DataFrame, keys: Sequence[str], version: str, keep: Sequence[str] = ()) -> DataFrame:
    """Insert or replace by key: the row of the greatest version wins, the delta's on ties.

    Columns in ``keep`` stay as they were first stored.
    """
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.withColumn("_side", F.lit(1)))
    new = latest(both, list(keys), [version, "_side"]).drop("_side")
    if not keep:
        return new
    old = base.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    return new.join(old, list(keys), "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])


def cascade_deleted(child: DataFrame, doomed: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is not among the doomed."""
    return child.join(doomed.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def progress(blocks: DataFrame, positions: DataFrame) -> DataFrame:
    """Reading progress in percent: place of the last read block among the paper's; null for unknown blocks."""
    b = with_place(blocks.select("paper_id", "block_id", "block_order"), ["paper_id"], ["block_order", "block_id"], total="n").drop("block_order")
    return positions.join(b, ["paper_id", "block_id"], "left").withColumn("percent", F.floor(100 * F.col("place") / F.col("n") + 0.5).cast("int"))


def day_label(ts: Column, now: datetime) -> Column:
    """today, yesterday, 'N days' below a week, else the date."""
    days = F.datediff(F.lit(now).cast("date"), ts.cast("date"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def display_title(translated: Column, original: Column, file_name: Column) -> Column:
    return F.coalesce(filled(F.trim(translated)), filled(F.trim(original)), filled(F.trim(file_name)), F.lit("(untitled)"))


def only_membership(memberships: DataFrame) -> DataFrame:
    """The folder of papers that lie in exactly one."""
    g = memberships.groupBy("paper_id").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    return g.where("n = 1").select("paper_id", "node_id")


def seeded(base: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Insert if absent."""
    return base.unionByName(seed.join(base.select(key), key, "left_anti"))
