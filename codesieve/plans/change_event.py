"""A change event end to end: changed files in; annotations, comments and conclusion out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.operators import changes, enrich, options, selection
from codesieve.plans.scan import ScanOptions, scan, verdicts


def prepare(change_rows: DataFrame, meta: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to scan and (batch_id, ai_generated) of change events."""
    files = selection.change_set(change_rows, max_files, max_chars)
    flags = meta.select("batch_id", options.ai_generated(
        F.col("config_ai_generated"), F.col("env_value"), F.col("labels"), F.col("config_labels"), F.col("title"), F.col("body"),
        F.col("commit_messages")).alias("ai_generated"))
    return files, flags


def report(change_rows: DataFrame, meta: DataFrame, existing: DataFrame | None = None,
           scan_options: ScanOptions | None = None, max_files: int | None = None, max_chars: int | None = None,
           limit: int | None = None) -> dict[str, DataFrame]:
    """Annotations, review comments and the summary with the conclusion, per event.

    Everything is scanned and reported unless the caller passes a limit.
    """
    files, flags = prepare(change_rows, meta, max_files, max_chars)
    flagged = files.join(flags, "batch_id", "left")
    findings = scan(flagged, options=scan_options)
    _, batch = verdicts(flagged, findings)
    totals = enrich.batch_totals(meta, findings)
    labelled = meta.select("batch_id", changes.has_override(F.col("labels")).alias("overridden"))
    summary = (
        totals.join(batch, "batch_id", "left").join(labelled, "batch_id")
        .withColumn("policy", F.coalesce("policy", F.lit("advisory"))).withColumn("files_scanned", F.coalesce("files_scanned", F.lit(0)))
        .withColumn("conclusion", changes.conclusion(F.col("policy"), F.col("overridden")))
        .withColumn("summary", changes.summary_text(F.col("overridden")))
    )
    return {
        "annotations": changes.annotations(findings, files, limit),
        "comments": changes.review_comments(findings, files, changes.diff_lines(files), existing, limit),
        "highlights": changes.highlights(findings, limit),
        "summary": summary,
    }
