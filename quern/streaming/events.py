"""Event streams: filters, windows and sinks on Structured Streaming (or batches of the same rows)."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths

# The types of events.
EVENT_TYPES = (
    "entries_created", "entries_updated", "entries_deleted", "versions_created", "versions_deleted", "versions_promoted", "versions_restored", "users_created",
    "users_activated", "users_deactivated", "permissions_changed", "imports_completed", "indexes_updated", "errors", "tokens_exchanged", "api_keys_created",
    "api_keys_revoked", "plugins_deployed", "plugins_removed", "heartbeat", "files_shared", "metrics", "gc_started", "gc_completed", "tasks_created",
    "tasks_started", "tasks_completed", "tasks_failed", "tasks_cancelled", "syncs_completed", "syncs_failed", "server_ready",
)


HEARTBEAT_SECONDS, READY = 15, "server_ready"


def checked_types(types: list[str]) -> list[str]:
    """The types, each of the catalogue; another is an error."""
    unknown = sorted(set(types) - set(EVENT_TYPES))
    if unknown:
        raise ValueError(f"no such event types: {', '.join(unknown)}")
    return types


def catalogue(spark: SparkSession) -> DataFrame:
    """(event_type) of all events that there are."""
    return spark.createDataFrame([(t,) for t in EVENT_TYPES], "event_type string")


def heartbeats(spark: SparkSession, start_ms: int, end_ms: int, node_id: int = 0) -> DataFrame:
    """One heartbeat at each 15th second of the clock in [start, end): event_type, intent_time, node_id."""
    step = HEARTBEAT_SECONDS * 1000
    ticks = spark.range(-(-start_ms // step), -(-end_ms // step))
    return ticks.select(F.lit("heartbeat").alias("event_type"), (F.col("id") * step).alias("intent_time"), F.lit(node_id).cast("long").alias("node_id"))


def heartbeat_stream(spark: SparkSession, node_id: int = 0) -> DataFrame:
    """The same as an endless stream: of the ticks of a clock that gives one a second, those on the boundary."""
    at = F.unix_seconds("timestamp")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(at % HEARTBEAT_SECONDS == 0)
    return ticks.select(F.lit("heartbeat").alias("event_type"), (at * 1000).alias("intent_time"), F.lit(node_id).cast("long").alias("node_id"))


def pulse(counters: DataFrame, ts: str = "ts", every: str = "15 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics events: for each interval the last value of every other column, and their change a second since the interval before."""
    from pyspark.sql import Window

    names = [c for c in counters.columns if c not in (ts, *by)]
    seen = counters.groupBy(F.window(ts, every)["start"].alias("start"), *by).agg(*(F.max_by(c, ts).alias(c) for c in names), F.max(ts).alias("_at"))
    w = Window.partitionBy(*by).orderBy("start")
    seconds = F.unix_millis("_at") - F.unix_millis(F.lag("_at").over(w))
    return seen.select("start", *by, *names, *(F.coalesce(F.try_divide((F.col(c) - F.lag(c).over(w)) * 1000.0, seconds), F.lit(0.0)).alias(f"{c}_per_second") for c in names))


def frames(events: DataFrame, id_: str = "event_id") -> DataFrame:
    """(n, frame): server-sent events, a server_ready first, then each event's id, type and payload in the order of ids."""
    text = F.concat(F.lit("id: "), F.col(id_).cast("string"), F.lit("\nevent: "), F.col("event_type"), F.lit("\ndata: "), F.coalesce(F.col("payload"), F.lit("{}")), F.lit("\n\n"))
    ready = events.sparkSession.range(1).select(F.lit(None).cast(events.schema[id_].dataType).alias("n"), F.lit(f"event: {READY}\ndata: {{}}\n\n").alias("frame"))
    return ready.unionByName(events.select(F.col(id_).alias("n"), text.alias("frame"))).orderBy(F.col("n").asc_nulls_first())


def reindex_on(events: DataFrame, changed: Callable[[DataFrame], None], checkpoint: str, types: tuple[str, ...] = ("indexes_updated",)):
    """Run changed on each batch of events of the types: indexes follow their configuration, each batch at least once."""

    def batch(df: DataFrame, _: int) -> None:
        mine = df.where(F.col("event_type").isin(*checked_types(list(types))))
        if not mine.isEmpty():
            changed(mine)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def payload_paths(payload: Column) -> Column:
    """The paths an event is about: those of its entries, or else its own."""
    entries = F.from_json(payload, "entries array<struct<path:string>>, path string")
    own = F.transform(entries["entries"], lambda e: e["path"])
    return F.array_compact(F.coalesce(own, F.array(entries["path"])))


def select_events(events: DataFrame, types: list[str] | None = None, prefix: str | None = None, recipient: str | None = None, globs: list[str] | None = None) -> DataFrame:
    """Events of the types, about a path under the prefix and inside the globs, for everyone or the recipient."""
    if types is not None:
        events = events.where(F.col("event_type").isin(*types))
    if prefix is not None:
        events = events.where(F.exists(payload_paths(F.col("payload")), lambda p: paths.under(p, prefix)))
    if globs is not None:
        fits = "|".join(f"(?:{paths.glob_regex(g)})" for g in globs) or "(?!)"
        events = events.where(F.exists(payload_paths(F.col("payload")), lambda p: p.rlike(fits)))
    if recipient is not None:
        events = events.where(F.col("recipient_user_id").isNull() | (F.col("recipient_user_id") == recipient))
    return events


def tumbling(events: DataFrame, ts: str, width: str, keys: tuple[str, ...] = (), late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by window; bounded state by the watermark."""
    measures = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    grouped = (events.withWatermark(ts, late) if events.isStreaming else events).groupBy(F.window(ts, width), *keys).agg(*measures)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *[c for c in ("n", "total") if c in grouped.columns])


def sessions(events: DataFrame, ts: str, gap: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Counts by session: events of a key that follow each other within the gap."""
    grouped = (events.withWatermark(ts, late) if events.isStreaming else events).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet, exactly once, then stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sign(secret: str, body: str) -> str:
    """HMAC-SHA256 in lower-case hex."""
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def signature(secret: str, body: Column) -> Column:
    """sign() of a column, by built-in functions: two SHA-256 over the padded key."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0")).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def webhook(stream: DataFrame, secret: str, deliver: Callable[[str, str], None], checkpoint: str):
    """Send each event's JSON and signature, from the executors; at least once."""

    def partition(rows) -> None:
        for row in rows:
            deliver(row[0], sign(secret, row[0]))

    def batch(df: DataFrame, _: int) -> None:
        df.select(F.to_json(F.struct(*df.columns))).foreachPartition(partition)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
