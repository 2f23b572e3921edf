"""What the operators of this subpackage share: checkpoints, labels, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join of at most so many bytes, by its counted rows, is broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: A graph of at most so many edges is resolved in one task; beyond it, step by step by joins.
SMALL_GRAPH = 16_384


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of spark.checkpoint.dir.

    Where none is configured, a folder of our own serves on a local master, as
    in tests; on a cluster that would be one machine's disk, so it is an error.
    Spark removes checkpoints that nothing refers to any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> int:
    """About what a row takes in a broadcast table; texts and lists count as 64 bytes."""
    return 24 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else 64 for f in df.schema.fields)


def is_small(df: DataFrame, rows: int) -> bool:
    return rows * row_bytes(df) <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its counted rows are within BROADCAST_BYTES."""
    return F.broadcast(df) if is_small(df, df.count() if rows is None else rows) else df


def range_parts(df: DataFrame, size: int = 64 << 20) -> int:
    """Partitions for a sort of what df gives: one for so many bytes of its input, and the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if known >= 1 << 60 else max(least, min(200_000, known // size))


def bucket(doc_id, n: int):
    """crc32 of doc_id as text, modulo n (null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _resolved(edges: DataFrame) -> DataFrame:
    """(node, component) of a small graph (u, v), in one task."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        nodes, place = np.unique(np.concatenate([*(u for u, _ in got), *(v for _, v in got)]), return_inverse=True)
        one, two = place[: len(place) // 2], place[len(place) // 2 :]
        root = np.arange(len(nodes))
        while True:
            new = root.copy()
            np.minimum.at(new, one, root[two])
            np.minimum.at(new, two, root[one])
            new = new[new]  # pointers leap ahead
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node reachable.

    Alternates large-star and small-star steps. Both are a map-side combined
    minimum and a join with it: by broadcast while there are few nodes, else a
    join whose skewed side can be split, so that a node with very many links is
    no hot task. Each round is checkpointed. A small graph is one task's.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, rows = None, now.count()
    if rows <= SMALL_GRAPH:
        return _resolved(now)
    for _ in range(max_rounds):
        if not rows:
            break
        small_enough = is_small(now, 2 * rows)
        side = F.broadcast if small_enough else materialise
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        large = large if small_enough else materialise(large)
        small = large.join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, rows = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
