"""A scan that configuration drives: every repository's own rules, toggles, names, block sizes, sector and policy.

Configurations are rows (see ``readers.read_config``).  What a repository's file leaves open, the organisation's decides.  Repositories
with equal rules share one scope, so the rule table grows with the different rule sets and not with the repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.functions import text
from codesieve.operators import detect, duplicates, enrich, licenses, options, policy, repository
from codesieve.operators.findings import union_findings
from codesieve.operators.skew import salted_join
from codesieve.sources import readers

#: Up to this many batches, their options are held by the driver and broadcast to the files; more meet them in a salted join.
HELD_BATCHES = 20_000
_TOGGLES = "naming boolean, logging boolean, error_handling boolean, typing boolean"
_RULES = "array<struct<id string, type string, message string, suggestion string, severity string, pattern variant>>"


def _positive(value: Column, default: int) -> Column:
    return F.when(value != 0, value).otherwise(default)


def configured_batches(batches: DataFrame, configs: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Batches (batch_id, repo; optional sector, policy, ai_generated of the request) with what their configuration decides.

    Columns: ``sector``, ``policy`` (map), ``copilot_strict``, ``config_override_allowed``, ``data_residency``, ``ip_min_lines``,
    ``ip_min_chars``, ``builtin`` (toggles, flat or by language), ``coding_standards`` (JSON), ``restricted`` and ``scope``, which
    names the set of user rules and restricted names.
    """
    def asked(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in batches.columns else F.lit(None).cast(kind)

    rows = readers.with_config(batches.withColumn("repo", F.coalesce("repo", F.lit(""))), configs, paths)
    own = F.coalesce(F.col("config.policy"), policy.policy_map(fv.DEFAULT_POLICY))
    decided = rows.select(
        "batch_id", "repo",
        options.resolve_sector(asked("sector", "string"), F.col("config.sector")).alias("sector"),
        policy.effective_policy(asked("policy", "map<string,string>"), asked("ai_generated", "boolean"), own).alias("policy"),
        asked("ai_generated", "boolean").alias("ai_generated"),
        F.coalesce("config.copilot_strict", F.lit(True)).alias("copilot_strict"),
        F.col("config.override_allowed").alias("config_override_allowed"), F.col("config.data_residency").alias("data_residency"),
        _positive(F.col("config.ip_min_lines"), fv.BLOCK_MIN_LINES).alias("ip_min_lines"),
        _positive(F.col("config.ip_min_chars"), fv.BLOCK_MIN_CHARS).alias("ip_min_chars"),
        F.col("config.coding_standards_builtin").alias("builtin"), F.col("config.coding_standards").alias("coding_standards"),
        F.coalesce("config.restricted_licenses", F.array(*[F.lit(x) for x in fv.RESTRICTED_LICENSES])).alias("restricted"))
    return decided.withColumn("scope", F.sha2(F.to_json(F.struct("coding_standards", "restricted")), 256))


def configured_rules(batches: DataFrame) -> DataFrame:
    """The rule table of configured batches: user rules and restricted names of each scope, as ``repository.detect_table`` reads them."""
    scopes = batches.groupBy("scope").agg(F.first("coding_standards").alias("coding_standards"), F.first("restricted").alias("restricted"))
    each = scopes.select("scope", F.posexplode(F.from_json("coding_standards", _RULES)).alias("at", "r"))
    one = F.expr("try_variant_get(r.pattern, '$', 'string')")
    patterns = F.when(F.expr("schema_of_variant(r.pattern) = 'STRING'"), F.array(one)).otherwise(F.expr("try_variant_get(r.pattern, '$', 'array<string>')"))
    user = each.select("*", F.posexplode(patterns).alias("pattern_at", "pattern")).select(
        F.col("scope").alias("repo"), F.lit("custom").alias("pack"), F.lit("custom").alias("kind"), F.lit("coding").alias("family"), F.lit("custom").alias("detector"),
        F.lit(5).alias("detector_ord"), (F.col("at") + 1).alias("rule_ord"), (F.col("pattern_at") + 1).alias("pattern_ord"), "pattern", F.lit(True).alias("multiline"),
        F.col("r.type").alias("type"), F.col("r.message").alias("message"), F.col("r.suggestion").alias("suggestion"), F.coalesce("r.severity", F.lit("warning")).alias("severity"),
        F.col("r.id").alias("rule_id"))
    names = scopes.select("scope", F.posexplode("restricted").alias("at", "name")).select(
        F.col("scope").alias("repo"), F.lit("builtin").alias("pack"), F.lit("restricted").alias("kind"), F.lit("license_ip").alias("family"),
        F.lit("restricted_license").alias("detector"), F.lit(2).alias("detector_ord"), (F.col("at") + 1).alias("rule_ord"), F.col("name").alias("pattern"),
        F.lit(True).alias("ignore_case"), F.lit(False).alias("multiline"), F.lit(True).alias("exists_only"), F.lit("restricted_license").alias("type"),
        F.concat(F.lit("Restricted license detected: "), "name", F.lit(".")).alias("message"), F.lit("blocking").alias("severity"), F.col("name").alias("license"))
    return user.unionByName(names, allowMissingColumns=True)


def _held(batches: DataFrame) -> tuple[DataFrame, bool]:
    """The options of few batches as a local table, whose size the planner knows and which is computed once."""
    rows = batches.limit(HELD_BATCHES + 1).toArrow()
    if rows.num_rows > HELD_BATCHES:
        return batches, False
    return batches.sparkSession.createDataFrame(rows, schema=batches.schema), True


def _toggles(builtin: Column, language: Column) -> Column:
    """The built-in coding checks that are on for a file; unset ones are on."""
    flat = F.struct(*[F.try_element_at(builtin, F.lit(n)).try_cast("boolean").alias(n) for n in ("naming", "logging", "error_handling", "typing")])
    per_language = F.transform_values(F.map_filter(builtin, lambda k, v: v.startswith("{")), lambda k, v: F.from_json(v, _TOGGLES))
    return options.resolve_toggles(flat, per_language, language)


def configured_findings(files: DataFrame, batches: DataFrame, unique_paths: bool = False, cross_file: bool = True, license_texts: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors under the options of ``configured_batches``, with policy levels and guideline links."""
    batches, few = _held(batches)
    wanted = batches.select("batch_id", "sector", F.col("scope").alias("repo"), "builtin", "ai_generated", "ip_min_lines", "ip_min_chars")
    own = files.join(F.broadcast(wanted), "batch_id", "left") if few else salted_join(files, wanted, ["batch_id"], "file_ord")
    language = text.guess_language(F.col("path"), F.col("language") if "language" in files.columns else None)
    own = own.withColumn("toggles", _toggles(F.col("builtin"), language)).drop("builtin")
    found = detect.detect(own, R.builtin_rules() + R.sector_rules(), flag_generated=True)
    sizes = F.col("ip_min_lines"), F.col("ip_min_chars")
    parts = [found, repository.detect_table(own, configured_rules(batches)), duplicates.within_file_duplicates(own, *sizes)]
    if cross_file:
        parts.append(duplicates.cross_file_duplicates(own, *sizes, unique_paths=unique_paths))
    if license_texts is not None:
        parts.append(licenses.repo_licenses(license_texts, batches=batches))
    return enrich.add_guidelines(policy.apply_policy(union_findings(*parts), batches=batches))


def configured_scan(files: DataFrame, batches: DataFrame, configs: DataFrame, paths: list[str] | None = None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, verdict per file, verdict per batch) of batches from many repositories in one scan."""
    decided, _ = _held(configured_batches(batches, configs, paths))
    findings = configured_findings(files, decided, **how)
    per_file = policy.file_verdict(files, findings, decided)
    return findings, per_file, policy.batch_verdict(per_file)
