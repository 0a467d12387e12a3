"""Rewrite, scan again and report as one plan: a generation for the scan and one for each rewrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.operators import fixes, reports
from codesieve.plans.scan import scan
from codesieve.sources import generations

Scanner = Callable[[DataFrame], DataFrame]
Rewriter = Callable[[DataFrame], DataFrame]


def scan_into(files: DataFrame, path: str, scanner: Scanner = scan) -> None:
    """Scan files (batch_id, file_ord, path, code) into the first generation of a store."""
    generations.add(path, files, findings=scanner)


def rewrite(spark, path: str, rewriter: Rewriter = fixes.safe_fix, scanner: Scanner = scan) -> int:
    """Rewrite the files that have findings and scan the changed ones again; the number of changed files.

    ``rewriter`` gives files with their new text in ``code``, the old one in ``original`` and a list ``changes``, as ``fixes.safe_fix``
    does.  New texts, backups of the old ones, the changes and the new findings become the store's next generation together;
    findings of the changed files are replaced, also when none are left.
    """
    files, findings = generations.current(spark, path, "files").drop("original", "changes"), generations.current(spark, path, "findings")
    found = files.join(findings.select(*generations.KEYS).distinct(), generations.KEYS, "left_semi")
    changed = rewriter(found).where((F.size("changes") > 0) & (F.col("code") != F.col("original")))
    names = files.columns
    generations.add(path, changed.select(*names, "original", "changes"), findings=lambda stored: scanner(stored.select(*names)))
    newest = generations.folders(spark, path)[-1]
    return spark.read.parquet(f"{newest}/files").count()


def backups(spark, path: str) -> DataFrame:
    """(batch_id, file_ord, path, code) of the texts that rewrites replaced, with the generation that did."""
    out = None
    for n, folder in enumerate(generations.folders(spark, path)[1:], 1):
        rows = fixes.backup_rows(spark.read.parquet(f"{folder}/files")).withColumn("generation", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def report(spark, path: str, errors: DataFrame | None = None) -> DataFrame:
    """One row: what is left by family, errors, total, exit code, and how many files were rewritten."""
    left = reports.remaining(generations.current(spark, path, "findings"), errors)
    kept = backups(spark, path)
    fixed = 0 if kept is None else kept.select(*generations.KEYS).distinct().count()
    return left.withColumn("rewritten", F.lit(fixed).cast("bigint"))


def file_report(spark, path: str) -> DataFrame:
    """(batch_id, path, changes, a count for each family) of every file: the scan report with fix counts, one line for each file."""
    files, findings = generations.current(spark, path, "files"), generations.current(spark, path, "findings")
    counts = findings.groupBy(*generations.KEYS).agg(*[F.count_if(F.col("family") == family).alias(counter) for family, _, counter in fv.FAMILIES])
    changes = F.coalesce(F.col("changes"), F.array().cast("array<string>")) if "changes" in files.columns else F.array().cast("array<string>")
    named = files.select(*generations.KEYS, changes.alias("changes")).join(counts, generations.KEYS, "left")
    return named.select(*generations.KEYS, "changes", *[F.coalesce(counter, F.lit(0)).alias(counter) for _, _, counter in fv.FAMILIES])
