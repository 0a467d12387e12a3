"""The audit log: rows, resolutions, retention and the tamper-evident chain."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codesieve import fixed_values as fv
from codesieve.functions import text
from codesieve.operators.enrich import family_counts, redact_findings
from codesieve.operators.skew import ordered_running


#: Buckets of positions whose sizes are summed at a time when the log is cut.
CUT_BUCKETS = 4096


def iso_now() -> Column:
    """ISO-8601 UTC with microseconds and Z."""
    return iso_utc(F.current_timestamp())


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_REDACTED = ["code", "ai_api_key", "repo_license_texts"]


def audit_rows(batches: DataFrame, verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """One audit entry per batch: redacted request (``input``), and verdict and counts per family (``output``).

    The findings of a batch are not nested into its row; ``audit_output`` keeps them as a flat, redacted table under the same
    ``request_id``, and ``audit_files`` the request's files.
    """
    counts = family_counts(findings, ["batch_id"])
    names = [c for _, _, c in fv.FAMILIES]
    joined = batches.join(verdicts, "batch_id", "left").join(counts, "batch_id", "left")
    counted = F.struct(*[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in names])
    policy = F.coalesce("policy", F.lit("advisory")) if "policy" in verdicts.columns else F.lit("advisory")
    allowed = F.coalesce("override_allowed", F.lit(False))
    asked = [c for c in ("repo", "repo_path", "sector", "pr_number", "commit", "ai_generated", "require_ai_review", "ai_model") if c in batches.columns]
    hidden = [F.lit("<redacted>").alias(c) for c in _REDACTED if c == "code" or c in batches.columns]
    output = F.struct(policy.alias("policy"), allowed.alias("override_allowed"), F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"), counted.alias("counts"))
    return joined.select(
        F.col("batch_id").alias("request_id"), F.struct(*asked, *hidden).alias("input"), output.alias("output"), policy.alias("policy"),
        allowed.alias("override_allowed"), F.lit("unresolved").alias("resolution"))


def audit_files(files: DataFrame) -> DataFrame:
    """(request_id, path, size) of a request's files: what its audit entry keeps of them."""
    return files.select(F.col("batch_id").alias("request_id"), "path", F.length(F.coalesce("code", F.lit(""))).alias("size"))


def audit_output(findings: DataFrame) -> DataFrame:
    """Redacted findings under the id of their request."""
    return redact_findings(findings).withColumnRenamed("batch_id", "request_id").drop("at_line")


def resolution_rows(requests: DataFrame) -> DataFrame:
    """Resolution events from (audit_id, resolution, actor); both ids are required."""
    kept = requests.where("audit_id <> '' and resolution <> ''")
    return kept.select("audit_id", "resolution", "actor", F.lit("resolution").alias("event"))


def latest_resolution(audit: DataFrame) -> DataFrame:
    """Analyses with their newest resolution; without one they stay unresolved."""
    events = audit.where("event = 'resolution'").groupBy("audit_id").agg(
        F.max_by(F.struct("resolution", "actor", "timestamp"), F.struct("timestamp", "seq")).alias("last"))
    analyses = audit.where("event is null").drop("actor")
    return (
        analyses.withColumnRenamed("resolution", "_own").join(events, "audit_id", "left")
        .withColumn("resolution", F.coalesce("last.resolution", "_own"))
        .withColumn("actor", F.col("last.actor")).withColumn("resolved_at", F.col("last.timestamp")).drop("last", "_own"))


def _kept_from(audit: DataFrame, size: Column, budget: int) -> int | None:
    """The least ``seq`` from which on all newer rows together stay within the budget; None for an empty log.

    Sizes are summed per bucket of positions, at most ``CUT_BUCKETS`` rows come to the driver, and only the bucket in which
    the budget ends is looked into more closely, until it is a single position.
    """
    ends = audit.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if ends.lo is None:
        return None
    lo, hi, taken = ends.lo, ends.hi, 0
    while True:
        width = -(-(hi - lo + 1) // CUT_BUCKETS)
        inside = audit.where(F.col("seq").between(lo, hi)).groupBy(F.expr(f"(seq - {lo}L) div {width}L").alias("b")).agg(F.sum(size.cast("bigint")).alias("n"))
        cut = None
        for row in sorted(inside.collect(), key=lambda r: -r.b):
            if taken + row.n > budget:
                cut = row.b
                break
            taken += row.n
        if cut is None:
            return lo
        lo, hi = lo + cut * width, min(hi, lo + (cut + 1) * width - 1)
        if lo == hi:
            return lo + 1


def retained(audit: DataFrame, size: Column, max_bytes: int, segments: int = fv.AUDIT_MAX_SEGMENTS) -> DataFrame:
    """Newest rows whose total size stays within the active and the kept segments, with a segment number.

    Where the kept part begins is found from sums per bucket of positions; only its rows, which the budget bounds, are then
    ordered and numbered.
    """
    if max_bytes <= 0:
        return audit.withColumn("running", F.lit(None).cast("bigint")).withColumn("segment_no", F.lit(0).cast("bigint"))
    first = _kept_from(audit, size, max_bytes * (segments + 1))
    newest = audit.where(F.lit(False)) if first is None else audit.where(F.col("seq") >= first)
    total = ordered_running(newest, [], "seq", size, "running", descending=True)
    return total.withColumn("segment_no", F.floor((F.col("running") - 1) / max_bytes))


# --- hash chain -----------------------------------------------------------------------


def canonical_entry(entry: dict, prev: str | None) -> bytes:
    """Sorted JSON of an entry with the hash of the row before it."""
    return json.dumps({**entry, "prev_hash": prev}, sort_keys=True).encode("utf-8")


@F.pandas_udf(StringType())
def canonical_json(entries: pd.Series, prev: pd.Series) -> pd.Series:
    out = []
    for e, p in zip(entries, prev):
        out.append(None if e is None else canonical_entry(json.loads(e), p if isinstance(p, str) else None).decode("ascii"))
    return pd.Series(out, dtype=object)


def write_chain(rows: DataFrame, key: bytes) -> DataFrame:
    """(segment, seq, entry, hash, prev_hash): every row is signed together with the hash before it.

    A chain is sequential inside a segment, and a new segment starts with no previous hash, as
    after a rotation; segments are chained in parallel.  Batches of rows stream through the task,
    so a long segment is never held in memory.
    """

    def chain(batches):
        segment, prev = None, None
        for pdf in batches:
            hashes, before = [], []
            for seg, entry in zip(pdf.segment, pdf.entry):
                if segment is None or seg != segment:
                    segment, prev = seg, None
                digest = hmac.new(key, canonical_entry(json.loads(entry), prev), hashlib.sha256).hexdigest()
                before.append(prev)
                hashes.append(digest)
                prev = digest
            yield pdf.assign(hash=hashes, prev_hash=before)

    ordered = rows.select("segment", "seq", "entry").repartition("segment").sortWithinPartitions("segment", "seq")
    return ordered.mapInPandas(chain, "segment bigint, seq bigint, entry string, hash string, prev_hash string")


def verify_chain(log: DataFrame, key: bytes) -> DataFrame:
    """(segment, seq, hash_ok, link_ok) of every row.

    Each row holds the hash before it, so all rows are checked in parallel; the link is an
    equality join on the position, not a window over a segment.  Positions count up by one.
    """
    prior = log.select("segment", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_prior"))
    signed = text.hmac_sha256(key, canonical_json("entry", "prev_hash"))
    checked = log.select("segment", "seq", "prev_hash", (signed == F.col("hash")).alias("hash_ok"))
    return checked.join(prior, ["segment", "seq"], "left").select(
        "segment", "seq", "hash_ok", F.col("prev_hash").eqNullSafe(F.col("_prior")).alias("link_ok"))
