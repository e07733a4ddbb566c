"""Metrics, duplicate groups, audit rates and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets of normal strings.

    Both empty: 1, 1, 1.  Gold empty: 0, 1, 0.  Predicted empty: 1, 0, 0.
    """
    norm = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    p, g = norm(predicted), norm(gold)
    both = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) == 0, 1.0).otherwise(both / F.size(p))
    recall = F.when(F.size(g) == 0, 1.0).otherwise(both / F.size(g))
    precision = F.when((F.size(g) == 0) & (F.size(p) > 0), 0.0).otherwise(precision)
    f1 = F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return precision, recall, f1


def substring_recall(predicted: Column, gold: Column) -> Column:
    """Share of gold strings that some predicted string contains or is contained in; nothing to find is 1."""
    hit = F.filter(gold, lambda g: F.exists(predicted, lambda p: F.lower(p).contains(F.lower(g)) | F.lower(g).contains(F.lower(p))))
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(hit) / F.size(gold))


def pair_order(text: Column, pairs: Column) -> Column:
    """Share of (before, after) pairs of which both stand in the text, in this order."""
    t = F.lower(text)
    ok = F.filter(pairs, lambda p: (F.instr(t, F.lower(p["before"])) > 0) & (F.instr(t, F.lower(p["before"])) < F.instr(t, F.lower(p["after"]))))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(ok) / F.size(pairs))


def relation_recall(predicted: DataFrame, expected: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Share of expected edges that were predicted, per group; repeated expectations count each time."""
    p = predicted.select(by, *keys).distinct().withColumn("_hit", F.lit(1))
    return expected.join(p, [by, *keys], "left").groupBy(by).agg((F.count("_hit") / F.count("*")).alias("recall"))


def error_rate(predicted: Column, expected: Column) -> Column:
    """Edit distance over the expected length; 0 for nothing expected."""
    return F.when(F.length(expected) == 0, 0.0).otherwise(F.levenshtein(predicted, expected) / F.length(expected))


def duplicate_groups(df: DataFrame, key: str, hash_col: str, title_col: str, at: str) -> DataFrame:
    """Groups of equal hash, then of equal normal title among rows no hash group holds.

    kind, group_key, and the members in import order.  A hot key is one group of ids; texts do not travel.
    """
    members = F.transform(F.array_sort(F.collect_list(F.struct(at, key))), lambda x: x[key])
    by_hash = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("group_key")).agg(members.alias("members")).where(F.size("members") > 1)
    taken = by_hash.select(F.explode("members").alias(key))
    rest = df.join(taken, key, "left_anti")
    title = F.lower(F.trim(F.col(title_col)))
    by_title = rest.where(title != "").groupBy(title.alias("group_key")).agg(members.alias("members")).where(F.size("members") > 1)
    return by_hash.withColumn("kind", F.lit("hash")).unionByName(by_title.withColumn("kind", F.lit("title"))).select("kind", "group_key", "members")


def keep_oldest(df: DataFrame, group: str | Column, at: str, key: str) -> DataFrame:
    """Rows to delete: all but the oldest of each group."""
    w = Window.partitionBy(group).orderBy(at, key)
    return df.withColumn("_k", F.row_number().over(w)).where("_k > 1").drop("_k")


def status_counts(df: DataFrame, level: str, levels: Sequence) -> DataFrame:
    """One row: a zero-filled count per level, and the total."""
    return df.agg(*[F.count_if(F.col(level) == v).alias(f"n_{v}") for v in levels], F.count("*").alias("total"))


def rates(df: DataFrame, flags: dict[str, Column], groups: Sequence[Sequence[str]]) -> DataFrame:
    """Shares of flags for several groupings in one pass; the denominator is at least 1."""
    names = list(dict.fromkeys(g for gs in groups for g in gs))
    d = df.select(*names, *[c.cast("boolean").alias(f"_f_{k}") for k, c in flags.items()])
    n = F.count("*")
    g = d.groupingSets([list(x) for x in groups], *names) if names else d.groupBy()
    return g.agg(n.alias("n"), *[F.round(F.count_if(f"_f_{k}") / F.greatest(n, F.lit(1)), 6).alias(k) for k in flags])


def stratified(df: DataFrame, stratum: Column, order: Sequence[str], per_stratum: int) -> DataFrame:
    """The first rows of each stratum in a fixed order: a sampling operator, its size is its purpose."""
    w = Window.partitionBy("stratum").orderBy(*order)
    return df.withColumn("stratum", stratum).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_stratum).drop("_k")


def per_second(amount: Column, ms: Column, zero: float | None) -> Column:
    """Amount per second; a time of zero gives ``zero``."""
    return F.when(ms > 0, amount / (ms / 1000)).otherwise(F.lit(zero).cast("double"))


def coverage(sources: DataFrame, targets: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the greatest cosine of each source vector with the key's targets, and of each target vector with
    its sources: least and mean of both.

    Vectors meet only inside their key.  They are set to length one before they move, and both maxima come from
    partial maxima of the same pairs.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    side = lambda d, name: d.select(key, F.col("item").alias(f"_{name}i"), unit(F.col(vector).cast("array<double>")).alias(f"_{name}"))
    dot = F.aggregate(F.zip_with("_s", "_t", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = side(sources, "s").join(side(targets, "t"), key).select(key, "_si", "_ti", dot.alias("_d"))
    both = pairs.select(key, F.inline(F.array(F.struct(F.lit(True).alias("_src"), F.col("_si").alias("_i"), "_d"), F.struct(F.lit(False).alias("_src"), F.col("_ti").alias("_i"), "_d"))))
    best = both.groupBy(key, "_src", "_i").agg(F.max("_d").alias("best"))
    of = lambda src: F.when(F.col("_src") == src, F.col("best"))
    return best.groupBy(key).agg(
        F.round(F.min(of(True)), 6).alias("least"), F.round(F.avg(of(True)), 6).alias("mean"),
        F.round(F.min(of(False)), 6).alias("target_least"), F.round(F.avg(of(False)), 6).alias("target_mean"),
    )


def review_merge(fresh: DataFrame, saved: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(queue, archive): labels are carried over only where the translation is unchanged; reviewed rows that
    vanished are archived.  fresh: key, translation; saved: key, translation, labels."""
    s = saved.select(key, F.col("translation").alias("_t"), "labels")
    queue = fresh.join(s, key, "left").withColumn("labels", F.when(F.col("translation").eqNullSafe(F.col("_t")), F.col("labels"))).drop("_t")
    return queue, saved.where("labels IS NOT NULL").join(fresh.select(key), key, "left_anti")
