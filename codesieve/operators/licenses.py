"""Licenses named in the license files of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.functions import text
from codesieve.operators.detect import rule_hits
from codesieve.operators.findings import as_findings


def license_files(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Files with one of the exact license basenames; empty ones, and ones above ``max_chars`` if given, are dropped."""
    found = files.where(text.basename(F.col("path")).isin(fv.LICENSE_BASENAMES) & (F.col("code") != ""))
    return found if max_chars is None else found.where(F.length("code") <= max_chars)


def license_names(license_texts: DataFrame) -> DataFrame:
    """(batch_id, license, seen): distinct names per batch with the place where each is first seen.

    ``seen`` is the position of the text, the pattern, and the place in the text, in this order.
    """
    rules = R.license_rules()
    named = R.small_frame(license_texts.sparkSession, [{"rule_ix": ix, "rule_ord": r["rule_ord"], "name": r["license"]} for ix, r in enumerate(rules)], "rule_ix int, rule_ord int, name string")
    found = rule_hits(license_texts, rules).join(F.broadcast(named), "rule_ix").withColumn("license", F.coalesce("name", "g"))
    return found.groupBy("batch_id", "license").agg(F.min(F.struct("file_ord", "rule_ord", "start")).alias("seen"))


def repo_licenses(license_texts: DataFrame, restricted: list[str] | None = None, batches: DataFrame | None = None) -> DataFrame:
    """One finding per distinct license of a batch, one more when its name equals a restricted one.

    ``batches`` (batch_id, restricted) gives each batch names of its own in the place of one list for all.
    """
    names = fv.RESTRICTED_LICENSES if restricted is None else restricted
    low = F.lower("license").isin([n.lower() for n in names]) if names else F.lit(False)
    found = license_names(license_texts)  # a batch has few names
    if batches is not None:
        found = found.join(batches.select("batch_id", "restricted"), "batch_id", "left")
        low = F.coalesce(F.exists("restricted", lambda n: F.lower(n) == F.lower("license")), F.lit(False))
    kinds = F.when(low, F.array(F.lit("repo_license_detected"), F.lit("restricted_license"))).otherwise(
        F.array(F.lit("repo_license_detected")))
    rows = found.select("batch_id", "license", "seen", F.explode(kinds).alias("type"))
    detected = F.col("type") == "repo_license_detected"
    return as_findings(
        rows, family="repo_license", detector=F.col("type"), detector_ord=F.when(detected, 1).otherwise(2),
        rule_ord=F.col("seen.rule_ord"), pattern_ord=1, file_ord=F.col("seen.file_ord"),
        message=F.when(detected, F.format_string("Repository license detected: %s.", "license")).otherwise(
            F.format_string("Restricted license detected in repository: %s.", "license")),
        severity=F.when(detected, "warning").otherwise("blocking"))
