"""Change events: changed lines, annotations, review comments and the conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import regex
from codesieve.operators.skew import first_n

FAMILY_ORDER = ["issues", "coding", "license_ip", "sector"]


def diff_lines(changes: DataFrame, as_posted: bool = False) -> DataFrame:
    """(batch_id, path, line): right-side lines that a unified diff touches or shows.

    Inside a hunk the n-th line that is not a removal has the number ``start + n``, so no running
    state is needed.  By default file headers only count before the first hunk, and the marker
    for a missing final newline and the end of the text are no lines.  ``as_posted`` gives the
    plain reading: any ``+++``/``---`` line is a header, every other line counts, text before the
    first hunk starts at 0.
    """
    patch = F.coalesce("patch", F.lit(""))
    pieces = F.split(patch, r"(?md)^(?=@@.*\+[0-9])")
    # text before the first header is a hunk without one
    headed = F.filter(pieces, lambda h: F.startswith(h, F.lit("@@")) | F.lit(as_posted))

    def numbers(hunk: Column, at: Column) -> Column:
        start = F.coalesce(F.regexp_extract(hunk, r"\A@@[^\n]*?\+([0-9]+)", 1).try_cast("int"), F.lit(0))
        # the separator before the next hunk belongs to this one, it is no line of its own
        body = F.when(at < F.size(headed) - 1, F.regexp_replace(hunk, r"\n\z", "")).otherwise(hunk)
        lines = F.split(body, "\n", -1)
        lines = F.filter(lines, lambda x: ~F.startswith(x, F.lit("@@")) & ~F.startswith(x, F.lit("-")))
        if as_posted:
            lines = F.filter(lines, lambda x: ~F.startswith(x, F.lit("+++")))
        else:
            lines = F.filter(lines, lambda x, i: ~F.startswith(x, F.lit("\\")) & ~((x == "") & (i == F.size(lines) - 1)))
        return F.transform(lines, lambda x, i: start + i)

    found = F.array_distinct(F.flatten(F.transform(headed, numbers)))
    return changes.select("batch_id", "path", found.alias("found")).select(
        "batch_id", "path", F.explode_outer("found").alias("line")).where("line is not null")


def line_starts(files: DataFrame) -> DataFrame:
    """(batch_id, path, line, start, text): offset of every line, split at line feeds."""
    prepared = files.select("batch_id", "path", F.split("code", "\n", -1).alias("lines"))
    sums = F.expr(regex.running_sums_sql("transform(lines, x -> cast(length(x) + 1 as bigint))"))
    placed = prepared.select("batch_id", "path", "lines", sums.alias("r"))
    rows = F.expr(
        "transform(lines, (x, i) -> named_struct('line', i + 1, 'start', cast("
        + regex.sum_before_sql("r", "i") + " as int), 'text', x))")
    return placed.select("batch_id", "path", rows.alias("rows")).select("batch_id", "path", F.inline("rows"))


def locate(findings: DataFrame) -> DataFrame:
    """Set ``line`` from the start offset where the detector gave none; rows without both go.

    Detectors count the line feeds while they hold the text, so no join with the text is needed.
    """
    line = F.coalesce(F.when(F.col("line") > 0, F.col("line")), F.when(F.col("start").isNotNull(), F.col("at_line")))
    return findings.withColumn("line", line).where("line is not null")


def level_name(policy: Column) -> Column:
    return F.when(policy == "blocking", "failure").when(policy == "warning", "warning").otherwise("notice")


def message_text() -> Column:
    """Message, suggestion and references of a finding on separate lines; empty parts are left out."""

    def part(label: str, name: str) -> Column:
        value = F.col(name)
        return F.when(value != "", F.concat(F.lit(label), value))

    head = F.coalesce(F.when(F.col("message") != "", F.col("message")), F.col("type"))
    return F.concat_ws("\n", head, part("Suggestion: ", "suggestion"), part("OWASP: ", "owasp"), part("CWE: ", "cwe"),
                       part("Guideline: ", "guideline_url"))


def _placed(findings: DataFrame, files: DataFrame | None) -> DataFrame:
    """Findings with a line in files that have text, with a position inside their batch.

    The detectors only report files that have text; pass ``files`` for findings of other origin.
    The check reads the text column, so leave it out for large scans.
    """
    shown = locate(findings.where(F.col("family").isin(FAMILY_ORDER)))
    family_ord = F.array_position(F.array(*[F.lit(f) for f in FAMILY_ORDER]), F.col("family"))
    narrow = shown.select("batch_id", "file_ord", "path", family_ord.alias("family_ord"), "detector_ord", "rule_ord",
                          "pattern_ord", "start", "line", "type", "policy_level", message_text().alias("message"))
    if files is None:
        return narrow
    with_text = files.where("code <> ''").select("batch_id", "path").distinct()
    return narrow.join(with_text, ["batch_id", "path"], "left_semi")


def _order() -> list[Column]:
    return [F.col(c) for c in ("file_ord", "family_ord", "detector_ord", "rule_ord", "pattern_ord", "start", "line", "message")]


def annotations(findings: DataFrame, files: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Annotations of a batch, or the first ``limit`` of them, in file, family and detector order."""
    top = first_n(_placed(findings, files), ["batch_id"], _order(), limit)
    return top.select(
        "batch_id", "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        level_name(F.col("policy_level")).alias("annotation_level"),
        F.coalesce("type", F.lit("scan")).alias("title"), "message")


def existing_comments(comments: DataFrame, marker: str = fv.REVIEW_MARKER) -> DataFrame:
    """Distinct (batch_id, path, line, body) of earlier comments that carry the marker."""
    kept = comments.where((F.col("body") != "") & (F.col("path") != "") & (F.col("line") > 0) & F.contains("body", F.lit(marker)))
    return kept.select("batch_id", "path", "line", "body").dropDuplicates()


def new_comments(comments: DataFrame, existing: DataFrame) -> DataFrame:
    """Comments that were not posted before with the same batch, path, line and body."""
    keys = ["batch_id", "path", "line", "body"]
    return comments.join(existing.select(*keys), keys, "left_anti")


def review_comments(findings: DataFrame, files: DataFrame | None, changed: DataFrame, existing: DataFrame | None = None,
                    limit: int | None = None, marker: str = fv.REVIEW_MARKER) -> DataFrame:
    """Comments on changed lines that were not posted before; the first ``limit`` of a batch if given."""
    placed = _placed(findings, files).withColumn("body", F.concat("message", F.lit("\n" + marker)))
    placed = placed.join(changed.select("batch_id", "path", "line"), ["batch_id", "path", "line"], "left_semi")
    if existing is not None:
        placed = new_comments(placed, existing)
    top = first_n(placed, ["batch_id"], _order(), limit)
    return top.select("batch_id", "path", "line", F.lit("RIGHT").alias("side"), "body")


def highlights(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviewer texts of a batch, or the first ``limit`` of them."""
    said = findings.where("family = 'ai'").select(
        "batch_id", "file_ord", "rule_ord", F.coalesce(
            F.when(F.col("message") != "", F.col("message")), F.when(F.col("type") != "", F.col("type")),
            F.lit("AI suggestion")).alias("text"))
    return first_n(said, ["batch_id"], [F.col("file_ord"), F.col("rule_ord"), F.col("text")], limit)


def conclusion(policy: Column, overridden: Column | None = None) -> Column:
    """failure, neutral or success; an overridden blocking result is a success."""
    free = F.lit(False) if overridden is None else F.coalesce(overridden, F.lit(False))
    return F.when((policy == "blocking") & ~free, "failure").when(policy == "warning", "neutral").otherwise("success")


def has_override(labels: Column, label: str = fv.OVERRIDE_LABEL) -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def summary_text(overridden: Column | None = None) -> Column:
    """The eight summary lines of a batch with family totals, verdict and ``files_scanned``."""
    applied = F.lit("") if overridden is None else F.when(overridden, " (override applied)").otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Policy: "), F.col("policy"), applied),
        *[F.concat(F.lit(f"{label}: "), F.col(name).cast("string")) for label, name in [
            ("Files scanned", "files_scanned"), ("Security issues", "issues"), ("Coding issues", "coding"),
            ("License/IP issues", "license_ip"), ("Repo license issues", "repo_license"),
            ("Sector issues", "sector"), ("AI suggestions", "ai")]])


def report_text(summary: Column, said: Column, title: str = "Scan report") -> Column:
    """Comment body: the summary as a list, then the reviewer highlights if there are any."""
    listed = F.concat(F.lit(f"## {title}\n- "), F.replace(summary, F.lit("\n"), F.lit("\n- ")))
    extra = F.concat(F.lit("\n\n### AI review highlights\n- "), F.array_join(said, "\n- "))
    return F.when(F.size(said) > 0, F.concat(listed, extra)).otherwise(listed)
