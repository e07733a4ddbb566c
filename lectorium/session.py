"""Session-level helpers: parallelism, checkpoints, broadcast bounds."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def width(spark: SparkSession) -> int:
    """Tasks a Python or sort stage should have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all slots before costly per-row work.

    A scan of few files gives few tasks; only then is the (narrow) input exchanged.  With keys the rows
    of a key meet, without keys the exchange is round robin.  At scale a scan already has more splits
    than slots, and nothing moves unless keys ask for it.
    """
    spark = df.sparkSession
    if not keys and df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(width(spark), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session takes a temporary folder, any other one its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "lectorium")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lectorium"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is ``shared_folder``, unless the session has a checkpoint folder already.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write once, read many: a parquet table in the shared checkpoint folder.

    For frames that several branches of a plan read: unlike a checkpoint it is columnar and compressed, so
    each branch reads its own columns.  It survives the loss of executors.  The table is removed when the
    driver process ends.
    """
    path = f"{shared_folder(df.sparkSession)}/lectorium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append((df.sparkSession, path))
    return df.sparkSession.read.parquet(path)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed like stored tables."""
    path = f"{shared_folder(spark)}/lectorium-{name}-{uuid.uuid4().hex}"
    _STORED.append((spark, path))
    return path


_STORED: list = []


@atexit.register
def _remove_stored() -> None:
    for spark, path in _STORED:
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: the cluster's own cleaning takes the folder
            return


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast hint for a side that is proven small: its row count is taken first.

    Beyond ``most_rows`` the frame comes back without the hint, and the join shuffles.
    """
    counted = df.limit(most_rows + 1).count()
    return F.broadcast(df) if counted <= most_rows else df
