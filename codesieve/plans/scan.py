"""The batch scan: files and options in; findings, verdicts and totals out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.operators import detect, duplicates, enrich, licenses, policy, review
from codesieve.operators.findings import union_findings


@dataclass
class ScanOptions:
    """Options that hold for a whole scan; per-batch values come with ``batches``."""

    sector: str = fv.DEFAULT_SECTOR
    sector_rules: DataFrame | list[dict] | None = None
    custom_rules: list[dict] = field(default_factory=list)
    restricted: list[str] = field(default_factory=lambda: list(fv.RESTRICTED_LICENSES))
    min_lines: int = fv.BLOCK_MIN_LINES
    min_chars: int = fv.BLOCK_MIN_CHARS
    copilot_strict: bool = True
    unique_paths: bool = False
    cross_file: bool = True
    review: bool = False


def findings_of(files: DataFrame, options: ScanOptions | None = None, license_texts: DataFrame | None = None,
                extra: list[DataFrame] | None = None) -> DataFrame:
    """All findings without policy levels.

    All pattern rules run in one pass over the text, but for sector rules of a table longer than ``PLAN_RULES``;
    duplicates and repository licenses are the only other readers of it.
    """
    o = options or ScanOptions()
    sector = R.sector_rules() if o.sector_rules is None else R.collect_rules(o.sector_rules)
    long_table = isinstance(o.sector_rules, DataFrame) and len(sector) > R.PLAN_RULES
    if "sector" not in files.columns:  # without a sector per file the default pack applies
        sector = [r for r in sector if r["pack"] == o.sector]
    rules = R.builtin_rules() + R.restricted_rules(o.restricted) + R.custom_rules(o.custom_rules) + ([] if long_table else sector)
    found = detect.detect(files, rules, flag_generated=True)
    if long_table:
        packs = o.sector_rules if "sector" in files.columns else o.sector_rules.where(F.col("pack") == o.sector)
        found = union_findings(found, detect.detect(files, packs))
    parts = [found, duplicates.within_file_duplicates(files, o.min_lines, o.min_chars)]
    if o.cross_file:
        parts.append(duplicates.cross_file_duplicates(files, o.min_lines, o.min_chars, o.unique_paths))
    if license_texts is not None:
        parts.append(licenses.repo_licenses(license_texts, o.restricted))
    if o.review:
        parts.append(review.missing_key(files))
    return union_findings(*parts, *(extra or []))


def scan(files: DataFrame, batches: DataFrame | None = None, options: ScanOptions | None = None,
         license_texts: DataFrame | None = None, extra: list[DataFrame] | None = None) -> DataFrame:
    """Findings with policy levels and guideline links.

    ``batches`` may carry one policy map per batch.  Write the result to a table when several
    reports follow: it is small next to the text.
    """
    o = options or ScanOptions()
    found = findings_of(files, o, license_texts, extra)
    leveled = policy.apply_policy(found, batches=batches, strict=o.copilot_strict) if batches is not None else \
        policy.apply_policy(found, strict=o.copilot_strict)
    return enrich.add_guidelines(leveled)


def verdicts(files: DataFrame, findings: DataFrame, batches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdict per file and per batch."""
    per_file = policy.file_verdict(files, findings, batches)
    return per_file, policy.batch_verdict(per_file)
