"""Delta sync of arriving chunks with keyed state: a change log instead of a table that is written anew with each batch.

A run of a file is all rows with its context, filename and run time. State is kept for each (context, filename): the newest run, and a
map from content hash to (position, last run that had it). A new hash is an insert, a moved one an update. Once the watermark
passes the newest run, a timer fires, and hashes that this run did not bring are removed: until then its rows may still come
in any order and batch, also after rows of a later run. A repeated row changes nothing. Rows of a run that a newer one of the
same file has overtaken change nothing either, as the newer run says what the file holds. Rows later than the watermark are
dropped by Spark, so `late` says how late a row may be.

State grows with the chunks that files hold now, spread over RocksDB stores by (context, filename); a file that an empty run closes
keeps one value. The log is written by Spark's file sink, so a restart repeats no change. current() folds it into the table.

Defined cases: null hashes are no chunks: such a row only says that its file was processed in this run; null context or filename is a
value of its own; rows without a run time, or with one not after 1970-01-01 00:00 (where watermarks begin), are left out; of equal hashes in one run the least position counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "context string, filename string, content_hash string, position long, action string, run_at timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileSync(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "run long")
        self.chunks = handle.getMapState("chunks", "hash string", "position long, run long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = newest = self.newest.get()[0] if self.newest.exists() else None
        for r in rows:  # one at a time: a file may hold most of a batch
            run, content, position = _millis(r.run_at), r.content_hash, r.position if r.position is not None else -1
            newest = run if newest is None else max(newest, run)
            if run < newest or not content:
                continue
            held = self.chunks.getValue((content,)) if self.chunks.containsKey((content,)) else None
            if held is None or held[1] < run or position < held[0]:
                if held is None or held[0] != position:
                    yield self._row(key, content, position, "insert" if held is None else "update", run)
                self.chunks.updateValue((content,), (position, run))
        if newest != known:
            self.newest.update((newest,))
            self.handle.registerTimer(newest + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = self.newest.get()[0]
        if expiredTimerInfo.getExpiryTimeInMs() <= newest:  # a newer run came meanwhile and has a timer of its own
            return
        gone = [(h[0], v[0]) for h, v in self.chunks.iterator() if v[1] < newest]
        for content, position in gone:
            self.chunks.removeKey((content,))
            yield self._row(key, content, position, "delete", newest)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, content: str, position: int, action: str, run: int) -> Row:
        return Row(context=key[0], filename=key[1], content_hash=content, position=position, action=action, run_at=datetime.fromtimestamp(run / 1000, timezone.utc).replace(tzinfo=None))


def _millis(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def changes(arrivals: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """The change log (CHANGES) of a stream of rows (context, filename, content_hash, position, run_at)."""
    rows = arrivals.select("context", "filename", "content_hash", F.col("position").cast("long").alias("position"), F.date_trunc("MILLISECOND", F.col("run_at").cast("timestamp")).alias("run_at")).where("run_at is not null")
    return rows.withWatermark("run_at", late).groupBy("context", "filename").transformWithState(FileSync(), CHANGES, "Append", "EventTime")


def run_sync(spark: SparkSession, arrivals: DataFrame, log: str, checkpoint: str, *, late: str = "1 hour") -> None:
    """Everything there is, appended to the log, then stop. Keyed state of this kind needs RocksDB stores."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        changes(arrivals, late=late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)


def current(log: DataFrame) -> DataFrame:
    """The table that a log leaves: context, filename, content_hash, position and the run that last changed the chunk."""
    last = F.max_by(F.struct("position", "action"), F.struct("run_at", F.col("action") != "delete", -F.col("position")))
    rows = log.groupBy("context", "filename", "content_hash").agg(last.alias("l"), F.max("run_at").alias("run_at"))
    return rows.where("l.action <> 'delete'").select("context", "filename", "content_hash", "l.position", "run_at")
