"""The folder that all executors share, and sides of joins that are small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, a row counting as ROW_BYTES.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="quern-shared-")
        sc.setCheckpointDir(folder)
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def small_side(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted rows are few; counting reads no more than the join would."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df
