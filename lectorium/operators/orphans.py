"""References to records that do not exist.

Method: keys become 128-bit digests; the digest space is cut into ranges, so ranges are even whatever the
keys look like.  Parents of a range are kept as sorted arrays; batches of references are probed against
them by vectorised binary search, and misses are aggregated.

Skew: ranges that draw many references (one key may hold a third of all) are cut into salts, and only the
parents of those ranges are copied to each salt.  The plan of ranges and salts has one row per range.

Defined results: ids compare without letter case and outer blanks; a null or blank reference is no case; a
parent counts from its earliest ``created_at`` and is gone when its latest version is deleted; an empty
parent table makes every reference an orphan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task holds at a time.
GROUP_ROWS = 200_000


def plain_id(c: Column | str) -> Column:
    """Lower case, without blanks at either end; null when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.regexp_replace(c, r"^[\s 　﻿]+|[\s 　﻿]+$", ""))
    return F.when(t != "", t)


def live_parents(df: DataFrame, kind: str, ids: list[str]) -> DataFrame:
    """One row per parent key: ``key`` and ``since`` (microseconds), null when the latest version is deleted."""
    key = F.concat_ws("\u0001", F.lit(kind), *[plain_id(i) for i in ids])
    present = reduce(lambda a, b: a & b, [plain_id(i).isNotNull() for i in ids])
    gone = F.max_by(F.col("deleted_at").isNotNull(), F.struct("updated_at", F.col("deleted_at").isNotNull()))
    g = df.where(present).groupBy(key.alias("key")).agg(F.min("created_at").alias("at"), gone.alias("gone"))
    return g.select("key", F.when(~F.col("gone"), F.unix_micros(F.col("at").cast("timestamp"))).alias("since"))


def references(df: DataFrame, ref_table: str, kind: str, ids: list[str], ref_key: Column, made_at: str) -> DataFrame:
    """One row per reference: ref_table, ref_key, key, made (microseconds), period (first of the month)."""
    present = reduce(lambda a, b: a & b, [plain_id(i).isNotNull() for i in ids])
    key = F.concat_ws("\u0001", F.lit(kind), *[plain_id(i) for i in ids])
    return df.where(present).select(
        F.lit(ref_table).alias("ref_table"), ref_key.alias("ref_key"), key.alias("key"), F.unix_micros(F.col(made_at).cast("timestamp")).alias("made"), F.trunc(F.col(made_at), "month").alias("period")
    )


def _digest(d: DataFrame, bits: int) -> DataFrame:
    d = d.withColumns({"h": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))}).drop("key")
    return d.withColumn("rng", F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0))


def probe(refs: pd.DataFrame, parents: pd.DataFrame) -> np.ndarray:
    """True for each reference that finds a live parent in time, by binary search in the sorted parents."""
    order = np.lexsort((parents["h2"].to_numpy(np.int64), parents["h"].to_numpy(np.int64)))
    h, h2 = parents["h"].to_numpy(np.int64)[order], parents["h2"].to_numpy(np.int64)[order]
    since = parents["since"].to_numpy(dtype="float64", na_value=np.nan)[order]
    rh, rh2, made = refs["h"].to_numpy(np.int64), refs["h2"].to_numpy(np.int64), refs["made"].to_numpy(dtype="float64", na_value=np.nan)
    ok = np.zeros(len(refs), bool)
    if not len(h):
        return ok
    at = np.searchsorted(h, rh)
    open_ = np.ones(len(refs), bool)
    while open_.any():  # equal first digests lie side by side; nearly always one round
        inside = np.minimum(at, len(h) - 1)
        same = open_ & (at < len(h)) & (h[inside] == rh)
        hit = same & (h2[inside] == rh2)
        ok |= hit & (since[inside] <= made)
        open_ = same & ~hit
        at = at + 1
    return ok


def with_found(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References with ``found``."""
    total = refs.count() + parents.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total / GROUP_ROWS)))))
    r, p = _digest(refs, bits), _digest(parents, bits)
    # one row per range: how many salts its references need
    plan = r.groupBy("rng").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int").alias("salts"))
    r = r.join(F.broadcast(plan) if bits <= 14 else plan, "rng").withColumn("salt", F.pmod(F.xxhash64("ref_key", "made"), F.col("salts")).cast("int")).drop("salts")
    p = p.join(F.broadcast(plan) if bits <= 14 else plan, "rng").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(refs_: pd.DataFrame, parents_: pd.DataFrame) -> pd.DataFrame:
        return refs_.assign(found=probe(refs_, parents_))[["ref_table", "ref_key", "period", "found"]]

    return r.groupBy("rng", "salt").cogroup(p.groupBy("rng", "salt")).applyInPandas(run, "ref_table string, ref_key string, period date, found boolean")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    return with_found(refs, parents).where("NOT found").select("ref_table", "ref_key", "period")


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References and misses per table and month."""
    g = with_found(refs, parents).groupBy("ref_table", "period")
    return g.agg(F.count("*").alias("n_refs"), F.count_if(~F.col("found")).alias("n_orphans"))
