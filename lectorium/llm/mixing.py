"""Mixing sources to target weights.

Method: tokens are summed per source; a repetition rate per source follows from its target share; each
document is emitted floor(rate) times, and once more with the probability of the fraction, decided by a
seeded hash of its id, so the choice is the same in any run and on any number of executors.

The total is the largest at which every source can reach its share within ``max_repeats``, unless one is
given; then a source that would need more is held at its cap, and its shortfall shows in the shares.

Defined results: names are compared without case and blanks, and a name one or two letters off exactly one
target is that target's; null names, names outside the mix and texts without tokens are left out; a
target without documents reaches share 0 and does not bind the total; shares are renormalised over
the rest for the total only, never in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.session import small

#: Rows up to which the table of names travels to the documents; a longer one meets them in a shuffle.
MOST_NAMES = 10_000
#: Letters by which a name may differ, and the fewest letters of a name that may.
OFF, OFF_LENGTH = 2, 5


def _shortened(name: Column) -> Column:
    """The name and all strings that lack one or two of its letters: two names at most ``OFF`` apart share one."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(name), less(name), F.flatten(F.transform(less(name), less))))


def names(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target: the stored names that stand for a target.  Near names meet by what is left of them when
    letters are taken out, so no name is held against all targets."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s_\-.]+", ""))
    t = targets.where("source IS NOT NULL").select(F.col("source").alias("target"), F.lower(F.trim("source")).alias("t"))
    have = documents.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).select("source", plain("source").alias("p"))
    exact = have.join(t, F.col("p") == F.col("t")).groupBy("source").agg(F.min("target").alias("target"))
    longest = t.agg(F.max(F.length("t"))).first()[0] or 0
    rest = have.join(exact, "source", "left_anti").where((F.length("p") >= OFF_LENGTH) & (F.length("p") <= longest + OFF))
    cut = lambda d, c: d.withColumn("k", F.explode(_shortened(F.col(c))))
    near = cut(rest, "p").join(cut(t, "t"), "k").where(F.levenshtein("p", "t") <= OFF).groupBy("source").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    return exact.unionByName(near.where("n = 1").select("source", "target"))


def rates(documents: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """documents: source, tokens.  Gives a row per target: available, rate (copies per document)."""
    have = documents.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs"))
    t = targets.join(have, "source", "left").fillna(0, ["available", "n_docs"])
    if total is None:
        row = t.where("available > 0 AND target_share > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()
        total = float(row[0] or 0.0)
    want = F.col("target_share") * F.lit(total)
    return t.withColumn("rate", F.when(F.col("available") > 0, F.least(want / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0))


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate) plus one hash-seeded Bernoulli copy."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate + 1e-9) + (u < rate - F.floor(rate + 1e-9)).cast("int")).cast("int")


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id, source, tokens.  Gives the selection (a row per copy) and the shares reached."""
    d = documents.where("tokens > 0")
    known = small(names(d, targets), MOST_NAMES)
    d = d.join(known, "source").select("doc_id", F.col("target").alias("source"), "tokens")
    r = rates(d, targets, total)
    s = d.join(small(r.select("source", "rate"), MOST_NAMES), "source")
    s = s.withColumn("n", copies(F.col("rate"), F.col("doc_id"), seed)).where("n > 0")
    chosen = s.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "tokens")
    got = s.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("selected"), F.sum("n").alias("n_copies"))
    report = r.join(got, "source", "left").fillna(0, ["selected", "n_copies"])  # one row per target
    every = F.sum("selected").over(Window.partitionBy(F.lit(0)))
    report = report.withColumn("share_reached", F.when(every > 0, F.col("selected") / every).otherwise(0.0))
    return chosen, report
