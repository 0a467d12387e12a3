"""Writers (K1-K7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.operators.audit import audit_files, audit_output, resolution_rows
from codesieve.operators.fixes import backup_rows
from codesieve.sources import audit_log

#: Folders of reports and backups.
BUCKETS = 64
PACK_NAME = re.compile(r"[a-zA-Z0-9_-]+")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("batch_id"), F.lit(BUCKETS)).cast("int"))


def write_scan_report(nested: DataFrame, header: DataFrame, path: str, errors: DataFrame | None = None) -> None:
    """Scan report as JSON lines: ``files`` (one object per file, by batch) and ``batches`` (counts, verdict).

    A batch can hold any number of files, so its files are lines of their own and not one map; batches are dealt to
    ``BUCKETS`` folders by hash.
    """
    _bucketed(nested).write.mode("overwrite").partitionBy("bucket").json(f"{path}/files")
    header.write.mode("overwrite").json(f"{path}/batches")
    if errors is not None:
        errors.write.mode("overwrite").json(f"{path}/errors")


def append_audit(rows: DataFrame, path: str, findings: DataFrame | None = None, key: bytes = b"", files: DataFrame | None = None) -> audit_log.Head:
    """Append audit entries to the stored log and, when the output is kept, their redacted findings and the files' sizes."""
    if findings is not None:
        audit_output(findings).write.mode("append").parquet(f"{path}/output")
    if files is not None:
        audit_files(files).write.mode("append").parquet(f"{path}/input")
    return audit_log.append(rows, path, key)


def append_resolution(requests: DataFrame, path: str, key: bytes = b"") -> audit_log.Head:
    """Append resolution events to the same log."""
    return audit_log.append(resolution_rows(requests), path, key)


def upsert_rulepack(rules: DataFrame, path: str, name: str) -> None:
    """Replace one pack; other packs stay untouched."""
    if not PACK_NAME.fullmatch(name):
        raise ValueError("invalid rulepack name")
    (rules.withColumn("pack", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("pack").parquet(path))


def write_backups(fixed: DataFrame, path: str) -> None:
    """Original texts of changed files, in ``BUCKETS`` folders by the hash of their batch."""
    _bucketed(backup_rows(fixed)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def export_audit(audit: DataFrame, path: str) -> None:
    """The whole log as JSON lines, in gzip files: its field names and entries repeat."""
    audit.write.mode("overwrite").option("compression", "gzip").json(path)
