"""Neighbours in order within groups of any size.

A plain window puts a whole group into one task.  Here the order is cut into stretches of ``span``; windows
run within a stretch, and one row per stretch links it to the next, so a group that holds a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.session import stored


def with_next(df: DataFrame, keys: Sequence[str], order: str, tie: str, columns: Sequence[str], prefix: str = "next_", span: int = 1024) -> DataFrame:
    """Append the columns of the row behind, by (order, tie); null for the last of a group.

    ``order`` is an integer column.  Rows whose order is null come first, as one stretch.  Group keys may be
    null: they form one group.
    """
    d = df.withColumn("_stretch", F.floor(F.col(order) / span))
    row = F.struct(*[F.col(c) for c in columns])
    place = F.struct(F.col(order), F.col(tie))
    w = Window.partitionBy(*keys, "_stretch").orderBy(order, tie)
    d = d.withColumns({"_in": F.lead(row).over(w), "_at": F.row_number().over(w)})
    first = df.withColumn("_stretch", F.floor(F.col(order) / span)).groupBy(*keys, "_stretch").agg(F.min_by(row, place).alias("_first"))
    first = first.withColumn("_over", F.lead("_first").over(Window.partitionBy(*keys).orderBy(F.col("_stretch").asc_nulls_first())))
    a, b = d.alias("a"), first.drop("_first").alias("b")
    on = F.col("a._stretch").eqNullSafe(F.col("b._stretch"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    n = F.coalesce("_in", "_over")
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in df.columns], *[n[c].alias(prefix + c) for c in columns])


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (keys, order), written once; ``_p`` numbers the ranges in order.

    A group that is larger than a range lies in several of them, so no task holds it.
    """
    return stored(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))


def _met(d: DataFrame, ends: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Rows with the columns of their piece of their group (a row per group and piece)."""
    a, b = d.alias("a"), ends.alias("b")
    on = F.col("a._p") == F.col("b._p")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select("a.*", *[F.col(f"b.{c}") for c in columns])


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "place", total: str | None = None) -> DataFrame:
    """Append the number of each row in its group, from 1, by ``order`` (unique in a group), and the group's rows.

    Group keys may be null: they form one group.
    """
    d = _pieces(df, keys, order)
    w = Window.partitionBy(*keys, "_p").orderBy(*order)
    n = d.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    g = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(g.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumns({"_before": before, "_all": F.sum("_n").over(g)})
    d = _met(d.withColumn("_in", F.row_number().over(w)), n, keys, "_before", "_all").withColumn(out, (F.col("_before") + F.col("_in")).cast("int"))
    return (d.withColumn(total, F.col("_all")) if total else d).drop("_p", "_in", "_before", "_all")


def with_carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, own: bool = True) -> DataFrame:
    """Append the last value that is not null at or before each row of its group (``own``), or before it."""
    d = _pieces(df.withColumn("_v", value), keys, order)
    w = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = d.groupBy(*keys, "_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_past", F.last("_end", ignorenulls=True).over(past))
    d = _met(d.withColumn("_here", F.last("_v", ignorenulls=True).over(w)), ends, keys, "_past")
    return d.withColumn(out, F.coalesce("_here", "_past")).drop("_p", "_v", "_here", "_past")
