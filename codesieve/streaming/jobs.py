"""Streaming forms (T1-T5).  Every job takes a checkpoint folder on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from codesieve import fixed_values as fv
from codesieve.operators.audit import iso_utc
from codesieve.operators.limiter import HELD_ROWS, LIMIT, Admissions
from codesieve.plans.scan import ScanOptions, scan, verdicts

#: The state store that timers and lists of state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODES = {"available": {"availableNow": True}}


def scan_stream(files: DataFrame, findings_path: str, verdict_path: str, checkpoint: str, options: ScanOptions | None = None,
                audit_path: str | None = None, **trigger) -> StreamingQuery:
    """Scan arriving files (T1) and append redacted audit rows (T5).

    A micro-batch may hold many scan batches; all files of one batch must arrive together.  Output
    folders are named by the micro-batch and overwritten on a retry, so a re-run adds nothing twice.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        from codesieve.operators.audit import audit_output, audit_rows

        scan(batch, options=options).write.mode("overwrite").parquet(f"{findings_path}/epoch={epoch}")
        found = batch.sparkSession.read.parquet(f"{findings_path}/epoch={epoch}")
        _, per_batch = verdicts(batch, found)
        per_batch.write.mode("overwrite").parquet(f"{verdict_path}/epoch={epoch}")
        if audit_path is not None:
            done = batch.sparkSession.read.parquet(f"{verdict_path}/epoch={epoch}")
            audit_rows(done.select("batch_id"), done, found).write.mode("overwrite").json(f"{audit_path}/log/epoch={epoch}")
            audit_output(found).write.mode("overwrite").parquet(f"{audit_path}/output/epoch={epoch}")

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or MODES["available"])).start()


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def audit_trends(audit: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running counts per day and policy (T2); rows later than the delay are dropped."""
    policy = F.coalesce("policy", F.lit("advisory"))
    counted = _timed(audit).withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(
        *[F.count_if(policy == level).alias(level) for level in fv.LEVELS])
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *fv.LEVELS)


def admission_stream(requests: DataFrame, window: int = fv.RATE_WINDOW_SECONDS, limit: int = LIMIT, delay: str = "1 hour",
                     held_rows: int = HELD_ROWS) -> DataFrame:
    """Admission of arriving requests (client, ts, id) with per-client state.

    Rows of one micro-batch are taken in time order; later micro-batches are not reordered, and rows later than the delay are
    dropped.  A client's state ends when it was silent for a window and the watermark has passed.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = _timed(requests).withWatermark("ts", delay).select("client", "id", F.unix_micros("ts").alias("us"), "ts")
    return keyed.groupBy("client").transformWithStateInPandas(Admissions(window, limit, held_rows), "client bigint, id bigint, us bigint, admitted boolean", "Append", "EventTime")


def new_comments(comments: DataFrame, delay: str = "1 day") -> DataFrame:
    """Comments not posted before within the delay (T4); needs an event time ``ts``."""
    return _timed(comments).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["batch_id", "path", "line", "body"])


def audit_stream(rows: DataFrame) -> DataFrame:
    """Redacted audit rows of arriving results with a time column ``ts`` (T5)."""
    return rows.select(iso_utc(F.col("ts")).alias("timestamp"), "audit_id", "policy", F.lit("<redacted>").alias("code"),
                       F.lit("unresolved").alias("resolution"))


def append_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append a stream to files, exactly once."""
    writer: DataStreamWriter = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or MODES["available"])).start()
