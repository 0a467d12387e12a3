"""Batches whose files arrive over several micro-batches: one scan and one verdict per batch.

Arriving files are stored first.  A second stream over the stored files keeps, per batch, which positions have arrived; when
all have, or when nothing came for a while of event time, it names the batch, and the batch is scanned whole from the
stored files.  Findings that need several files (copies across files) are therefore those of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codesieve.plans.scan import ScanOptions, scan, verdicts
from codesieve.streaming.jobs import MODES, ROCKS

#: Folders into which stored files are dealt, so that a completed batch is read from its own folder.
BUCKETS = 64
_DONE = "batch_id string, files bigint, complete boolean"


class Arrivals(StatefulProcessor):
    """State of a batch: the positions that have arrived (in pages of 4096), their number, and until when it is kept."""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "page bigint", "places binary")
        self.count = handle.getValueState("count", "n bigint, wanted bigint, until bigint, done boolean")

    def _added(self, positions: np.ndarray) -> int:
        """How many of the positions are new; they are kept."""
        added, pages = 0, positions >> 12
        for page in np.unique(pages).tolist():
            old = np.frombuffer(self.seen.getValue((page,))[0], np.uint16) if self.seen.containsKey((page,)) else np.zeros(0, np.uint16)
            new = np.union1d(old, (positions[pages == page] & 4095).astype(np.uint16))
            if len(new) > len(old):
                self.seen.updateValue((page,), (new.tobytes(),))
                added += len(new) - len(old)
        return added

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, wanted, until, done = self.count.get() if self.count.exists() else (0, None, 0, False)
        for pdf in rows:
            if not done:
                n += self._added(np.unique(pdf.file_ord.to_numpy(np.int64)))
            if pdf.n_files.notna().any():
                wanted = max(wanted or 0, int(pdf.n_files.max()))
            until = max(until, int(pdf.ms.max()) + self.idle)
        if not done and wanted is not None and n >= wanted:
            done = True
            self.seen.clear()
            yield pd.DataFrame({"batch_id": [key[0]], "files": [n], "complete": [True]})
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        self.count.update((n, wanted, until, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: an incomplete batch ends with what has arrived, and the state is dropped."""
        n, _, _, done = self.count.get()
        self.seen.clear()
        self.count.clear()
        ended = pd.DataFrame({"batch_id": [key[0]], "files": [n], "complete": [False]})
        yield ended.head(0) if done else ended

    def close(self) -> None:
        pass


def ended_batches(arrivals: DataFrame, idle_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """(batch_id, files, complete) once per batch of a stream (batch_id, file_ord, n_files, ts).

    A batch is complete when ``n_files`` different positions have arrived; repeated ones count once.  Without news for
    ``idle_seconds`` after its last file (watermark ``delay``) it ends incomplete.  Its state is gone after that time.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = arrivals.where("file_ord is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed.select("batch_id", "file_ord", "n_files", F.unix_millis("ts").alias("ms"), "ts").withWatermark("ts", delay)
    return rows.groupBy("batch_id").transformWithStateInPandas(Arrivals(idle_seconds), _DONE, "Append", "EventTime")


def _bucket(batch_id: Column) -> Column:
    return F.pmod(F.xxhash64(batch_id), F.lit(BUCKETS)).cast("int")


def store_files(files: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store arriving files (batch_id, file_ord, path, code, n_files, ts) once each, by bucket of their batch."""
    bucketed = files.withColumn("bucket", _bucket(F.col("batch_id")))
    return bucketed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(
        "bucket").trigger(**(trigger or MODES["available"])).start()


def scan_ended_batches(spark: SparkSession, path: str, schema: str, findings_path: str, verdict_path: str, checkpoint: str,
                       options: ScanOptions | None = None, idle_seconds: int = 3600, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Scan the batches of ``store_files`` that have ended: findings, and (batch_id, policy, override_allowed, files_scanned, complete).

    ``schema`` is that of the stored files.  Output folders are named by the micro-batch and overwritten on a retry.
    """
    stored = spark.readStream.schema(f"{schema}, bucket int").parquet(path)

    def handle(ended: DataFrame, epoch: int) -> None:
        session = ended.sparkSession
        ended.write.mode("overwrite").parquet(f"{verdict_path}/ended/epoch={epoch}")
        done = session.read.schema(_DONE).parquet(f"{verdict_path}/ended/epoch={epoch}")
        buckets = [r.b for r in done.select(_bucket(F.col("batch_id")).alias("b")).distinct().collect()]  # at most BUCKETS
        files = session.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(buckets)).join(done.select("batch_id"), "batch_id", "left_semi")
        files = files.dropDuplicates(["batch_id", "file_ord"])
        scan(files, options=options).write.mode("overwrite").parquet(f"{findings_path}/epoch={epoch}")
        _, per_batch = verdicts(files, session.read.parquet(f"{findings_path}/epoch={epoch}"))
        per_batch.join(done.select("batch_id", "complete"), "batch_id").write.mode("overwrite").parquet(f"{verdict_path}/verdicts/epoch={epoch}")

    ended = ended_batches(stored, idle_seconds, delay)
    return ended.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or MODES["available"])).start()
