"""Structured Streaming: windowed counts and sessions over events, delta sync of arriving files, all incremental and restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A file stream of one table; path may name a single file or a folder of files."""
    path = path.rstrip("/")
    # As a pattern that only this name fits: sources of streams take folders and patterns, no names of files.
    return spark.readStream.format("parquet").schema(schema).options(**options).load(f"{path[:-1]}[{path[-1]}]")


def tumbling(events: DataFrame, *, ts: str = "ts", every: str = "1 hour", late: str = "1 hour", by: list[str] = ("event_type",)) -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, *, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(user, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Everything there is, then stop. each(batch, id) must be idempotent by id; without it, Parquet with exactly-once files."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", out)
    q = w.start()
    q.awaitTermination()


def sync_batches(stored_path: str, next_state: Callable[[DataFrame, DataFrame], DataFrame], start: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes one folder of new state per batch id: a repeated batch rewrites its own folder.
    start is the state before batch 0 (nothing if not given)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{stored_path}/state-{batch_id - 1}") if batch_id else batch.limit(0) if start is None else start
        next_state(before, batch).write.mode("overwrite").parquet(f"{stored_path}/state-{batch_id}")

    return each


def first_of_key(events: DataFrame, keys: list[str], *, order: list[str], late: str = "1 hour") -> DataFrame:
    """One row of each key: of a table the first by order; of a stream the first that comes, order[0] being its event time.

    A stream forgets a key when the watermark passes its row by `late`, so its state does not grow with all keys ever seen.
    """
    if events.isStreaming:
        return events.withWatermark(order[0], late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*events.columns)


def freshness(events: DataFrame, by: list[str], *, now: Column, most_seconds: int, ts: str = "ts") -> DataFrame:
    """newest event, age in whole seconds and whether it is stale, of each feed; a feed without times is stale."""
    newest = events.groupBy(*by).agg(F.max(ts).alias("newest"))
    rows = newest.withColumn("age", F.timestamp_diff("SECOND", F.col("newest"), now))
    return rows.withColumn("stale", F.coalesce(F.col("age") > most_seconds, F.lit(True)))
