"""Reports over findings and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import text

ARRAYS = [(name, counter) for _, name, counter in fv.FAMILIES]


def _size(col: Column) -> Column:
    return F.coalesce(F.when(col.isNotNull(), F.size(col)), F.lit(0))


def _nested_size(name: str) -> Column:
    """Items of one family over all files of a batch row."""
    values = F.map_values(F.col("output.findings"))
    return F.coalesce(F.aggregate(values, F.lit(0), lambda a, v: a + _size(v[name])), F.lit(0))


def summary(audit: DataFrame, faithful: bool = False) -> DataFrame:
    """One row: total, rows per policy, and the sums of finding counts per family.

    ``faithful`` counts every log row (resolutions too, as advisory) and only arrays directly under
    ``output``.  The default counts analyses and also takes nested batch findings and stored
    counts.  Both are one partial aggregation.
    """
    rows = audit if faithful else audit.where("event is null")
    policy = F.coalesce("policy", F.lit("advisory"))
    sums = []
    for name, counter in ARRAYS:
        value = _size(F.col(f"output.{name}"))
        if not faithful:
            value = value + _nested_size(name)
            value = F.when(value > 0, value).otherwise(F.coalesce(F.col(f"output.counts.{counter}"), F.lit(0)))
        sums.append(F.coalesce(F.sum(value), F.lit(0)).alias(counter))
    return rows.agg(
        F.count("*").alias("total_requests"),
        *[F.count_if(policy == level).alias(level) for level in fv.LEVELS], *sums)


def trends(audit: DataFrame) -> DataFrame:
    """Rows per day and policy; zero where there are none."""
    policy = F.coalesce("policy", F.lit("advisory"))
    return audit.groupBy(text.day_of(F.col("timestamp")).alias("day")).agg(
        *[F.count_if(policy == level).alias(level) for level in fv.LEVELS])


def recent(audit: DataFrame, n: int) -> DataFrame:
    """The last rows of the log, newest first; only the top rows of each partition are moved."""
    rows = audit.orderBy(F.col("seq").desc()).limit(n)
    return rows.select(
        "seq", "timestamp", F.initcap(F.coalesce("policy", F.lit(""))).alias("policy"),
        _size(F.col("output.issues")).alias("issue_count"),
        F.when(F.coalesce("override_allowed", F.lit(False)), "Yes").otherwise("No").alias("override_allowed"))


def total_analyses(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("total_analyses"))


def issue_counts(audit: DataFrame) -> DataFrame:
    """Issues per log row; batch rows nest theirs and show 0."""
    return audit.select("seq", _size(F.col("output.issues")).alias("issue_count"))


def breakdown(findings: DataFrame, dims: list[str]) -> DataFrame:
    """Finding counts over all combinations of the dimensions and their totals."""
    return findings.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def remaining(findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts left after a fix by family, the errors, the total and the exit code."""
    rows = findings.select("family")
    if errors is not None:
        rows = rows.unionByName(errors.select(F.lit("errors").alias("family")))
    both = rows.agg(
        *[F.count_if(F.col("family") == family).alias(name) for family, name, _ in fv.FAMILIES],
        F.count_if(F.col("family") == "errors").alias("errors"))
    total = sum((F.col(name) for name, _ in ARRAYS), F.col("errors"))
    return both.withColumn("total", total).withColumn("exit_code", F.when(F.col("total") > 0, 2).otherwise(0))
