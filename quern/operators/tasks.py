"""A queue of tasks as a log of (task_id, seq, task_type, args, status, at): scheduling, claiming, clean-up.

The log is append-only; each function gives rows to append, or rows that are
due, and keeps no state of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import schedule

# The states of a task.
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
DONE = (COMPLETED, FAILED, CANCELLED)


def due(minutes: DataFrame, schedules: list[tuple[str, str, str]], ts: str = "ts") -> DataFrame:
    """(schedule, task_type, ts) for every time that a schedule (name, cron, task type) fits."""
    rows = [minutes.where(schedule.cron_match(F.col(ts), cron)).select(F.lit(name).alias("schedule"), F.lit(kind).alias("task_type"), F.col(ts).alias("ts")) for name, cron, kind in schedules]
    return reduce(DataFrame.unionByName, rows)


def current(log: DataFrame) -> DataFrame:
    """The last entry of each task, and when the task first came."""
    last = log.groupBy("task_id").agg(F.max_by(F.struct("task_type", "args", "status", "at"), "seq").alias("_r"), F.min("at").alias("created_at"))
    return last.select("task_id", "_r.*", "created_at")


def next_pending(log: DataFrame, n: int = 1) -> DataFrame:
    """The n tasks that have waited longest."""
    return current(log).where(F.col("status") == PENDING).orderBy("created_at", "task_id").limit(n)


def moved_to(log: DataFrame, tasks: DataFrame, status: str, at: Column) -> DataFrame:
    """Entries that put the tasks (task_id) into a state; those that are done already stay as they are."""
    now = current(log).where(~F.col("status").isin(*DONE)).join(tasks.select("task_id"), "task_id", "left_semi")
    seq = log.groupBy("task_id").agg((F.max("seq") + 1).alias("seq"))
    return now.join(seq, "task_id").select("task_id", "seq", "task_type", "args", F.lit(status).alias("status"), at.alias("at"))


def cleaned(log: DataFrame, before: Column) -> DataFrame:
    """The log without the tasks that were done before a time."""
    old = current(log).where(F.col("status").isin(*DONE) & (F.col("at") < before)).select("task_id")
    return log.join(old, "task_id", "left_anti")
