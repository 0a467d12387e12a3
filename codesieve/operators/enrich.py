"""Enrichment, nesting and redaction of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.operators.findings import union_findings
from codesieve.operators.skew import salted_join
from codesieve.rules import small_frame
from codesieve.schemas import FINDING_FIELDS, FINDING_ORDER

LINKED_FAMILIES = ["issues", "coding", "license_ip", "sector"]


def guideline_frame(spark) -> DataFrame:
    rows = [{"type": k, "link": v} for k, v in fv.GUIDELINE_LINKS.items()]
    return small_frame(spark, rows, "type string, link string")


def add_guidelines(findings: DataFrame, guidelines: DataFrame | None = None) -> DataFrame:
    """Set ``guideline_url`` for the types that have a link; reviewer findings get none."""
    dim = guideline_frame(findings.sparkSession) if guidelines is None else guidelines.select("type", F.col("guideline_url").alias("link"))
    linked = findings.join(dim, "type", "left")
    url = F.when(F.col("family").isin(LINKED_FAMILIES), F.col("link"))
    return linked.withColumn("guideline_url", url).select(*findings.columns)


def add_cross_file(findings: DataFrame, cross_file: DataFrame) -> DataFrame:
    """Cross-file findings join the license family of their files."""
    return union_findings(findings, cross_file)


def repo_licenses_per_file(files: DataFrame, repo_findings: DataFrame) -> DataFrame:
    """Every file of a batch with every repository license finding of that batch."""
    dim = repo_findings.select("batch_id", "type", "license", "severity", "message")
    return salted_join(files.select("batch_id", "file_ord", "path"), dim, ["batch_id"], "file_ord", how="inner")


def family_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per family under ``keys``, one column per family."""
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col("family") == family).alias(counter) for family, _, counter in fv.FAMILIES])


def batch_totals(batches: DataFrame, findings: DataFrame) -> DataFrame:
    """Family totals of every batch, zeros included."""
    zero = batches.select("batch_id", F.lit(None).cast("string").alias("family"))
    return family_counts(zero.unionByName(findings.select("batch_id", "family")), ["batch_id"])


def finding_struct(redacted: bool = False) -> Column:
    """A finding as a struct whose natural order is the order inside its file."""
    skip = {"batch_id", "file_ord", "path", "family", "at_line", *FINDING_ORDER}
    names = [n for n in FINDING_FIELDS if n not in skip and not (redacted and n in fv.REDACTED_FIELDS)]
    return F.struct(*FINDING_ORDER, *[F.col(f"`{n}`") for n in names])


def nest_findings(files: DataFrame, findings: DataFrame, redacted: bool = False) -> DataFrame:
    """One row per file with an ordered array per family; files without findings get empty arrays.

    The arrays hold the findings of one file.  A whole batch is never nested into one row.
    """
    families = [f for f in fv.FAMILIES if f[0] != "repo_license"]
    item = finding_struct(redacted)
    own = findings.where("family <> 'repo_license'").select("batch_id", "file_ord", F.lit(None).cast("string").alias("path"), "family", item.alias("item"))
    kind = own.schema["item"].dataType
    base = files.select("batch_id", "file_ord", "path", F.lit(None).cast("string").alias("family"), F.lit(None).cast(kind).alias("item"))
    return base.unionByName(own).groupBy("batch_id", "file_ord").agg(
        F.max("path").alias("path"),
        *[F.sort_array(F.collect_list(F.when(F.col("family") == family, F.col("item")))).alias(name)
          for family, name, _ in families])


def redact_findings(findings: DataFrame) -> DataFrame:
    """Drop the fields that repeat source text or paths of other files."""
    return findings.drop(*[c for c in fv.REDACTED_FIELDS if c in findings.columns])


def redact_nested(result: DataFrame) -> DataFrame:
    """The same for a nested result."""
    out = result
    for _, name, _ in fv.FAMILIES:
        if name in result.columns:
            fields = [f for f in result.schema[name].dataType.elementType.names if f in fv.REDACTED_FIELDS]
            if fields:
                out = out.withColumn(name, _without(name, fields))
    return out


def _without(array: str, fields: list[str]) -> Column:
    return F.transform(F.col(array), lambda x: x.dropFields(*fields))


def redact_request(batches: DataFrame) -> DataFrame:
    """Audit form of a request: text and keys replaced, files as path and size."""
    out = batches
    for name in ("code", "ai_api_key", "repo_license_texts"):
        if name in batches.columns:
            out = out.withColumn(name, F.lit("<redacted>"))
    if "files" in batches.columns:
        out = out.withColumn("files", F.transform("files", lambda f: F.struct(
            f["path"].alias("path"), F.length(F.coalesce(f["code"], F.lit(""))).alias("size"))))
    return out


def output_counts(result: DataFrame) -> Column:
    """Counts per family of a nested result, for audit rows that do not keep the output."""
    return F.struct(*[
        (F.coalesce(F.size(F.col(name)), F.lit(0)) if name in result.columns else F.lit(0)).alias(counter)
        for _, name, counter in fv.FAMILIES])
