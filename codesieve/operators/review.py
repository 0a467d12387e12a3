"""Reviewer: prompts, answers and the pluggable call."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import text
from codesieve.operators.findings import as_findings
from codesieve.schemas import REVIEW_ITEM

# --- Fixed values: prompt texts ----------------------------------------------------
PROMPT_HEAD = [
    "You are an enterprise secure code reviewer.",
    "Return ONLY a JSON array of findings.",
    "Each finding must include: type, category (security|performance|maintainability|reliability|compliance), "
    "severity (advisory|warning|blocking), message, explanation, suggestion, references (array of URLs), and optional line.",
    "Focus on issues with clear evidence and explain why they matter.",
    "Prefer findings that reference the diff if provided.",
]
REWRITE_HEAD = (
    "You are a senior engineer. Rewrite the file to fix all findings and warnings. "
    "Preserve behavior unless a finding requires a change. Use best practices. "
    "Return ONLY the full updated file contents, no markdown or code fences."
)
MISSING_KEY_MESSAGE = "OPENAI_API_KEY is required for AI review."
MISSING_KEY_EXPLANATION = "Set OPENAI_API_KEY in the environment to enable AI review for all scans."
ERROR_MESSAGE = "AI review failed."
ERROR_SUGGESTION = "Retry the scan or disable AI review for this run."

#: Answers that a task holds before it sends them on.
ASKED_ROWS = 256


def normal_severity(col: Column) -> Column:
    low = F.lower(text.strip(col))
    return F.when(low.isin(fv.REVIEW_SEVERITIES), low).otherwise("advisory")


def normal_category(col: Column) -> Column:
    low = F.lower(text.strip(col))
    return F.when(low.isin(fv.REVIEW_CATEGORIES), low).otherwise("maintainability")


def static_severity(col: Column) -> Column:
    low = F.lower(text.strip(col))
    return (
        F.when(col.isNull() | (col == ""), "warning")
        .when(low.isin("error", "critical", "high"), "blocking")
        .when(low.isin("medium", "warning"), "warning")
        .otherwise("advisory")
    )


def prompt(code: Column, path: Column, language: Column, patch: Column, repo: Column, pr_number: Column, commit: Column,
           generated: Column, max_chars: Column | None = None) -> Column:
    """Review prompt of one file: with its whole text, or cut at a limit, which it then says.

    In a limit column, values that are not positive stand for the documented default.
    """
    limit = None if max_chars is None else F.when(max_chars > 0, max_chars).otherwise(F.lit(fv.REVIEW_MAX_CHARS))
    cut = [] if limit is None else [F.when(F.length(code) > limit, "Note: File content truncated for analysis.")]

    def told(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    head = F.concat_ws(
        "\n", *[F.lit(x) for x in PROMPT_HEAD],
        F.concat(F.lit("Repo: "), told(repo)),
        F.concat(F.lit("File: "), F.coalesce(path, F.lit("unknown"))),
        F.concat(F.lit("Language: "), F.coalesce(language, F.lit("unknown"))),
        F.concat(F.lit("PR: "), pr_number.cast("string")),
        F.when(commit != "", F.concat(F.lit("Commit: "), commit)),
        F.concat(F.lit("Copilot suspected: "), F.when(F.coalesce(generated, F.lit(False)), "True").otherwise("False")),
        *cut)
    shown = code if limit is None else text.truncate(code, limit)
    diff = F.concat(F.lit("\n\nDiff:\n"), patch, F.lit("\n\nFull file content (for context):\n"))
    return F.concat(head, F.when(patch != "", diff).otherwise(F.lit("\n\nFile content:\n")), shown)


def _valid(body: Column) -> Column:
    return F.when(F.try_parse_json(body).isNotNull(), body)


def answer_json(answer: Column) -> Column:
    """The JSON part of an answer: without fences; else from the first bracket to the last one."""
    bare = text.strip_fence(text.strip(answer), "(json)?")
    cut = F.nullif(F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0), F.lit(""))
    return F.coalesce(_valid(bare), _valid(cut))


def review_items(answer: Column) -> Column:
    """Array of sanitized findings of an answer; null when it holds no JSON.

    Entries are read as text first, so that one odd entry does not spoil the list.
    """
    body = text.strip(answer_json(answer))
    inner = F.when(F.startswith(body, F.lit("{")), F.from_json(body, "findings string").getItem("findings")).otherwise(body)
    entries = F.when(F.startswith(inner, F.lit("[")), F.from_json(inner, "array<string>"))
    objects = F.filter(entries, lambda x: F.startswith(x, F.lit("{")))

    def clean(entry: Column) -> Column:
        x = F.from_json(entry, REVIEW_ITEM)
        return F.transform(F.array(x), lambda x: F.struct(
            F.coalesce(x["type"], F.lit("ai_review")).alias("type"),
            normal_category(x["category"]).alias("category"),
            normal_severity(x["severity"]).alias("severity"),
            F.coalesce(x["message"], F.lit("AI review finding.")).alias("message"),
            F.coalesce(x["explanation"], F.lit("")).alias("explanation"),
            F.coalesce(x["suggestion"], F.lit("")).alias("suggestion"),
            F.coalesce(F.from_json(x["references"], "array<string>"), F.array().cast("array<string>")).alias("references"),
            x["line"].try_cast("int").alias("line"))).getItem(0)

    return F.when(body.isNotNull(), F.coalesce(F.transform(objects, clean), F.array()))


def missing_key(files: DataFrame) -> DataFrame:
    """Blocking findings of files whose review is required but has no key, in ``ai`` and ``issues``.

    ``files`` carries ``require_ai_review`` and ``has_key`` as booleans.
    """
    lacking = files.where("coalesce(require_ai_review, true) and not coalesce(has_key, false)")
    rows = lacking.select("batch_id", "file_ord", "path", F.explode(F.array(F.lit("ai"), F.lit("issues"))).alias("family"))
    return as_findings(
        rows, detector="ai_review_missing_key", detector_ord=F.when(F.col("family") == "ai", 1).otherwise(11), rule_ord=1,
        pattern_ord=1, type="ai_review_missing_key", message=MISSING_KEY_MESSAGE, explanation=MISSING_KEY_EXPLANATION,
        severity="blocking")


def ask(prompts: DataFrame, reviewer: Callable[[str], str]) -> DataFrame:
    """(batch_id, file_ord, path, answer, error): one call per prompt, inside the tasks.

    Prompts become Python texts one at a time; answers are sent on after ``ASKED_ROWS`` of them.
    """

    def call(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED_ROWS):
                part = batch.slice(at, ASKED_ROWS)
                answers, errors = [], []
                for p in part.column(3):
                    try:
                        answers.append(reviewer(p.as_py()))
                        errors.append(None)
                    except Exception as exc:  # a failed call becomes a finding
                        answers.append(None)
                        errors.append(str(exc))
                said = [pa.array([None if x is None else str(x) for x in col], pa.string()) for col in (answers, errors)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *said], names=["batch_id", "file_ord", "path", "answer", "error"])
            batch = part = None  # freed before the next one is read

    return prompts.select("batch_id", "file_ord", "path", "prompt").mapInArrow(
        call, "batch_id string, file_ord bigint, path string, answer string, error string")


def answers_to_findings(answers: DataFrame) -> DataFrame:
    """Sanitized findings of answers; failed calls and answers without JSON become error findings."""
    parsed = answers.withColumn("items", review_items(F.col("answer")))
    failed = F.col("items").isNull()
    error = F.array(F.struct(
        F.lit("ai_review_error").alias("type"), F.lit("reliability").alias("category"), F.lit("warning").alias("severity"),
        F.lit(ERROR_MESSAGE).alias("message"), F.coalesce("error", F.lit("No JSON found in response.")).alias("explanation"),
        F.lit(ERROR_SUGGESTION).alias("suggestion"), F.array().cast("array<string>").alias("references"),
        F.lit(None).cast("int").alias("line")))
    rows = parsed.select("batch_id", "file_ord", "path", F.posexplode(F.when(failed, error).otherwise(F.col("items"))).alias("pos", "x"))
    fields = ["type", "category", "severity", "message", "explanation", "suggestion", "references", "line"]
    flat = rows.select("batch_id", "file_ord", "path", "pos", *[F.col(f"x.{f}").alias(f) for f in fields])
    return as_findings(flat, family="ai", detector="ai_review", detector_ord=1, rule_ord=F.col("pos") + 1, pattern_ord=1)


def review(files: DataFrame, reviewer: Callable[[str], str], max_chars: int | None = None) -> DataFrame:
    """Findings of a reviewer over all files; it sees whole texts, or ``max_chars`` characters of each."""

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in files.columns else F.lit(None).cast(kind)

    asked = files.select("batch_id", "file_ord", "path", prompt(
        F.col("code"), F.col("path"), text.guess_language(F.col("path"), column("language")), column("patch"), column("repo"),
        column("pr_number", "int"), column("commit"), column("ai_generated", "boolean"), None if max_chars is None else F.lit(max_chars)).alias("prompt"))
    return answers_to_findings(ask(asked, reviewer))


def rewrite(files: DataFrame, rewriter: Callable[[str], str]) -> DataFrame:
    """(batch_id, file_ord, path, code, updated, error) from files with a ``findings_json`` column.

    Empty files are not sent; an empty answer keeps the text.
    """
    asked = files.where(text.strip(F.col("code")) != "").select("batch_id", "file_ord", "path", F.concat(
        F.lit(REWRITE_HEAD + "\n\nFile: "), F.col("path"), F.lit("\nLanguage: "), text.guess_language(F.col("path")),
        F.lit("\nFindings: "), F.col("findings_json"), F.lit("\n\nOriginal file:\n"), F.col("code")).alias("prompt"))
    answers = ask(asked, rewriter).select("batch_id", "file_ord", "answer", "error")
    bare = F.btrim(text.strip_fence(F.col("answer")), F.lit("\n"))
    updated = F.when(text.strip(bare) != "", bare).otherwise(F.col("code"))
    return files.join(answers, ["batch_id", "file_ord"], "left").select(
        "batch_id", "file_ord", "path", "code", updated.alias("updated"), "error")


def static_findings(results: DataFrame) -> DataFrame:
    """Findings of a static analyser from its JSON output, one ``json`` text per file."""
    from codesieve.schemas import STATIC_RESULTS

    parsed = results.withColumn("items", F.from_json("json", STATIC_RESULTS).getItem("results"))
    rows = parsed.select("batch_id", "file_ord", "path", F.posexplode("items").alias("pos", "x")).where("x is not null")
    meta = F.col("x.extra.metadata")
    flat = rows.select(
        "batch_id", "file_ord", "path", "pos",
        F.coalesce(text.blank_to_null(F.col("x.extra.message")), text.blank_to_null(F.col("x.check_id")),
                   F.lit("Static analysis finding.")).alias("message"),
        static_severity(F.col("x.extra.severity")).alias("severity"),
        F.col("x.start.line").alias("line"),
        F.try_element_at(meta["cwe"], F.lit(1)).alias("cwe"), F.try_element_at(meta["owasp"], F.lit(1)).alias("owasp"),
        F.coalesce(meta["references"], F.array().cast("array<string>")).alias("references"))
    return as_findings(flat, family="issues", detector="static_analysis", detector_ord=10, rule_ord=F.col("pos") + 1,
                       pattern_ord=1, type="static_analysis", category="security",
                       suggestion="Review static analysis finding and remediate.")


def findings_json(nested: DataFrame) -> DataFrame:
    """Attach the nested findings of a file as JSON text for a rewrite prompt."""
    names = [c for c in nested.columns if c not in ("batch_id", "file_ord", "path")]
    return nested.withColumn("findings_json", F.to_json(F.struct(*names)))
