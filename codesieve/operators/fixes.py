"""Safe fixes, re-scan upserts and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import text

# The two inserted texts.
IMPORT_LINE = "import logging\n"
LOGGER_LINE = "\nlogger = logging.getLogger(__name__)\n"


def _docstring(quote: str) -> str:
    """A docstring that opens on this line: closed there, or by the next line with the quote, or by the end."""
    return rf"(?=[^\n]*{quote})(?:[^\n]*?{quote}[^\n]*?{quote}[^\n]*\n?|[^\n]*\n(?s:.*?){quote}[^\n]*\n?|(?s:.*))"


#: What stays above an import: interpreter line, coding line, blank lines, docstring.
_HEADER = (
    r"\A(?:#!/[^\n]*(?:\n|\z))?(?:[^\n]*coding[^\n]*(?:\n|\z))?(?:\s*(?:\n|\z))?"
    r"(?:(?=[^\S\n]*(?:[\"]{3}|[']{3}))(?:" + _docstring('["]{3}') + "|" + _docstring("[']{3}") + "))?"
)
_HAS_IMPORT = r"(?:\A|\n)[^\S\n]*import logging[^\S\n]*(?:\n|\z)"
_OTHER_LINE = r"\n[^\S\n]*+(?!import |from )\S"


def with_logger(code: Column) -> Column:
    """The text with an import of logging and a module logger, each put in only where it is missing.

    The import follows the header, the logger the import lines behind it.  Lines end at line feeds.
    """
    header = F.regexp_extract(code, _HEADER, 0)
    body = F.substr(code, F.length(header) + 1)
    other = F.regexp_instr(F.concat(F.lit("\n"), body), F.lit(_OTHER_LINE))
    block = F.when(other > 0, F.substr(body, F.lit(1), other - 1)).otherwise(body)
    imports = F.rtrim(block, F.lit(" \t\n\r\f\x0b"))
    line_end = F.when(imports != "", F.length(F.regexp_extract(F.substr(block, F.length(imports) + 1), r"\A[^\S\n]*\n?", 0))).otherwise(0)
    upto = F.length(imports) + line_end
    first = F.when(F.regexp_like(code, F.lit(_HAS_IMPORT)), "").otherwise(IMPORT_LINE)
    placed = F.concat(header, first, F.substr(body, F.lit(1), upto), F.lit(LOGGER_LINE), F.substr(body, upto + 1))
    return F.when(F.contains(code, F.lit("logging.getLogger(__name__)")), F.concat(header, first, body)).otherwise(placed)


def safe_fix(files: DataFrame) -> DataFrame:
    """``files`` with the fixed text in ``code``, the old one in ``original`` and the list ``changes``.

    Only Python files that call print are rewritten.
    """
    applies = F.coalesce((text.extension(F.col("path")) == ".py") & F.contains("code", F.lit("print(")), F.lit(False))
    logged = with_logger(F.replace("code", F.lit("print("), F.lit("logger.info(")))
    done, none = F.array(F.lit("replace_print_with_logger")), F.array().cast("array<string>")
    return files.withColumn("original", F.col("code")).withColumn("changes", F.when(applies, done).otherwise(none)).withColumn(
        "code", F.when(applies, logged).otherwise(F.col("code")))


def backup_rows(fixed: DataFrame) -> DataFrame:
    """Original texts of changed files, to be written before the new ones."""
    return fixed.where(F.size("changes") > 0).select("batch_id", "file_ord", "path", F.col("original").alias("code"))


def refresh(findings: DataFrame, rescanned_files: DataFrame, rescanned_findings: DataFrame) -> DataFrame:
    """Findings after a re-scan: files scanned again replace their old rows, also when nothing is left."""
    again = rescanned_files.select("batch_id", "path").distinct()
    kept = findings.join(again, ["batch_id", "path"], "left_anti")
    return kept.unionByName(rescanned_findings, allowMissingColumns=True)
