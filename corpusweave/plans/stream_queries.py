"""Queries that run a stream to its end over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read
from corpusweave.scratch import shared_dir
from corpusweave.streaming import sync
from corpusweave.streaming.events import stream_table

#: Seconds at turn 0: a stream's first watermark is 1970, and rows at or before it are late.
_FIRST = 2**35


@query("""WITH r AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text <> ''), n AS (SELECT conv_id, max(turn) AS newest FROM r GROUP BY 1)
SELECT DISTINCT role_id AS filename, content_hash, position FROM (SELECT conv_id::VARCHAR AS role_id, md5(text) AS content_hash, min(length(text)) AS position FROM r JOIN n USING (conv_id) WHERE turn = newest AND newest < (SELECT max(newest) FROM n) GROUP BY 1, 2)""")
def synced_table(spark, sf_dir):
    """Each turn republishes its conversation; what the change log of the keyed stream leaves of those that a later turn settled."""
    table = read(spark, sf_dir, "conversations")
    stream = stream_table(spark, f"{sf_dir}/conversations.parquet", table.schema).where("conv_id is not null and text <> ''")
    rows = stream.select(F.lit("conversations").alias("context"), F.col("conv_id").cast("string").alias("filename"), F.md5("text").alias("content_hash"), F.length("text").alias("position"), F.timestamp_seconds(F.col("turn") + _FIRST).alias("run_at"))
    base = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    sync.run_sync(spark, rows, f"{base}/log", f"{base}/checkpoint", late="0 seconds")
    found = table.where("conv_id is not null and text <> '' and turn is not null")
    settled = found.groupBy(F.col("conv_id").cast("string").alias("filename")).agg(F.max("turn").alias("newest")).where(F.col("newest") < found.agg(F.max("turn")).scalar())
    return sync.current(spark.read.schema(sync.CHANGES).parquet(f"{base}/log")).join(settled, "filename", "left_semi").select("filename", "content_hash", "position")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT window_start, event_type, n, round(total, 4) AS total FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_windows(spark, sf_dir):
    """Hourly windows as a stream gives them: those that the watermark has closed, each once."""
    from corpusweave.streaming import events as S

    schema = read(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    rows = stream_table(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_available(S.tumbling(rows), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
