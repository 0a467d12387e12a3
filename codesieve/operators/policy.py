"""Policy levels: per finding, per file and per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.operators.skew import salted_join

FILE = ["batch_id", "file_ord"]


def level_rank(level: Column) -> Column:
    """advisory 0, warning 1, blocking 2; other texts do not count."""
    return F.when(level == "blocking", 2).when(level == "warning", 1).when(level == "advisory", 0)


def rank_level(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in fv.LEVELS]), F.coalesce(rank, F.lit(0)) + 1)


def bump(level: Column) -> Column:
    """One step up for findings in generated code."""
    return F.when(level == "advisory", "warning").when(level == "warning", "blocking").otherwise(level)


def policy_map(policy: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in policy.items() for x in pair])


def policy_frame(spark, policy: dict[str, str] | None = None) -> DataFrame:
    from codesieve.rules import small_frame

    rows = [{"type": k, "level": v} for k, v in (fv.DEFAULT_POLICY if policy is None else policy).items()]
    return small_frame(spark, rows, "type string, level string")


def effective_policy(request: Column, ai_generated: Column, configured: Column) -> Column:
    """The policy of a batch: the request's own; else the configured one, stricter for generated code.

    A request policy replaces the configured map, it is not merged with it.
    """
    strict = F.map_concat(
        F.map_filter(configured, lambda k, v: k != "copilot_generated_code"),
        F.create_map(F.lit("copilot_generated_code"), F.lit("blocking")))
    return (
        F.when(F.size(request) > 0, request)
        .when(F.coalesce(ai_generated, F.lit(False)), strict)
        .otherwise(configured)
    )


def apply_policy(findings: DataFrame, policy: DataFrame | None = None, batches: DataFrame | None = None,
                 strict: bool = True) -> DataFrame:
    """Set ``policy_level`` from the finding type; types without a level are advisory.

    ``policy`` is a (type, level) table for all findings; ``batches`` instead carries one map
    ``policy`` per batch and optionally ``copilot_strict``.
    """
    columns = findings.columns
    if batches is not None:
        flags = ["copilot_strict"] if "copilot_strict" in batches.columns else []
        dim = batches.select("batch_id", F.col("policy").alias("_map"), *[F.col(c).alias("_strict") for c in flags])
        joined = salted_join(findings, dim, ["batch_id"], "file_ord")
        base = F.coalesce(F.element_at("_map", F.col("type")), F.lit("advisory"))
        on = F.coalesce(F.col("_strict"), F.lit(True)) if flags else F.lit(strict)
    else:
        dim = policy_frame(findings.sparkSession) if policy is None else policy
        joined = findings.join(dim.select("type", F.col("level").alias("_level")), "type", "left")
        base, on = F.coalesce("_level", F.lit("advisory")), F.lit(strict)
    level = F.when(on & F.coalesce("copilot_strict", F.lit(False)), bump(base)).otherwise(base)
    return joined.withColumn("policy_level", level).select(*columns)


def override_allowed(policy: Column, configured: Column, stored: Column) -> Column:
    """Overrides exist for blocking results only: configured, else stored, else yes."""
    return F.when(policy == "blocking", F.coalesce(configured, stored, F.lit(True))).otherwise(F.lit(False))


def file_verdict(files: DataFrame, findings: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """(batch_id, file_ord, path, policy, override_allowed) of every file, with or without findings.

    Findings of the reviewer do not count.  Repository license findings (family ``repo_license``,
    one set per batch) count for every file of the batch.  Files and findings meet in one
    aggregation; there is no join with the text.
    """
    rank = level_rank(F.col("policy_level"))
    own = findings.where("family not in ('ai', 'repo_license')").select(*FILE, F.lit(None).cast("string").alias("path"), rank.alias("r"))
    base = files.select(*FILE, "path", F.lit(0).alias("r"))
    per_file = base.unionByName(own).groupBy(*FILE).agg(F.max("path").alias("path"), F.max("r").alias("r"))
    repo = findings.where("family = 'repo_license'").groupBy("batch_id").agg(F.max(rank).alias("repo_r"))
    joined = salted_join(per_file, repo, ["batch_id"], "file_ord")
    level = rank_level(F.greatest("r", "repo_r"))
    configured = stored = F.lit(None).cast("boolean")
    if batches is not None:
        names = [c for c in ("config_override_allowed", "stored_override_allowed") if c in batches.columns]
        joined = salted_join(joined, batches.select("batch_id", *names), ["batch_id"], "file_ord")
        configured = F.col(names[0]) if "config_override_allowed" in names else configured
        stored = F.col("stored_override_allowed") if "stored_override_allowed" in names else stored
    return joined.withColumn("policy", level).select(
        *FILE, "path", "policy", override_allowed(F.col("policy"), configured, stored).alias("override_allowed"))


def batch_verdict(verdicts: DataFrame) -> DataFrame:
    """Highest level of a batch, whether any file allows an override, and the files scanned."""
    return verdicts.groupBy("batch_id").agg(
        rank_level(F.max(level_rank(F.col("policy")))).alias("policy"),
        F.bool_or("override_allowed").alias("override_allowed"),
        F.count("*").alias("files_scanned"))
