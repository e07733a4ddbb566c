"""Second deliveries and versions: one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The newest row of each key.

    Rows are reduced map-side with ``max_by``, so a key that holds a third of all rows sends one row per
    task.  Ties in ``order`` fall to the greatest remaining columns, so the result is the same in any
    run.  Null order values lose to any other.  Rows whose key is null form one key.  An empty table
    gives an empty table.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    orderable = [c for c in rest if df.schema[c].dataType.typeName() not in ("map", "variant")]
    one = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*by, *[F.col(c) for c in orderable])).alias("_row")
    return df.groupBy(*keys).agg(one).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
