"""Which files are scanned: extension, size, status and count filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import text
from codesieve.operators.skew import first_n, ordered_number


def is_supported(path: Column, extensions: list[str] | None = None, anywhere: bool = False) -> Column:
    """Extension in the list; ``anywhere`` takes the part after the last dot of the whole path."""
    known = list(fv.LANGUAGE_BY_EXTENSION) if extensions is None else [e.lower() for e in extensions]
    if not known:
        return F.lit(True)
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)) if anywhere else text.extension(path)
    return ext.isin(known)


def supported_files(files: DataFrame, extensions: list[str] | None = None, anywhere: bool = False) -> DataFrame:
    return files.where(is_supported(F.col("path"), extensions, anywhere))


def size_cap(files: DataFrame, max_chars: int | None) -> DataFrame:
    """Files of at most ``max_chars`` characters; all for None."""
    return files if max_chars is None else files.where(F.length("code") <= max_chars)


def not_removed(changes: DataFrame) -> DataFrame:
    return changes.where("path is not null and path <> '' and (status is null or status <> 'removed')")


def change_set(changes: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Files of a change event that are scanned: all that pass the filters, or the first ``max_files`` of them."""
    kept = size_cap(supported_files(not_removed(changes), anywhere=True), max_chars)
    return first_n(kept, ["batch_id"], [F.col("file_ord")], max_files)


def max_files(files: DataFrame, limit: int) -> DataFrame:
    """First files by path; 0 means all."""
    return files.orderBy("path").limit(limit) if limit > 0 else files


def chunk_numbers(files: DataFrame, size: int = fv.CHUNK_FILES) -> DataFrame:
    """(batch_id, file_ord, chunk): consecutive files of a batch in chunks of ``size``.

    Positions may be hashes (``readers.number_files``): they are numbered in ranges between their quantiles.
    """
    numbered = ordered_number(files.select("batch_id", "file_ord"), ["batch_id"], "file_ord", bucket=None)
    return numbered.select("batch_id", "file_ord", F.floor((F.col("rn") - 1) / size).alias("chunk"))


def has_findings(result: DataFrame) -> Column:
    """Any of the family arrays of a nested result holds an item."""
    arrays = [name for _, name, _ in fv.FAMILIES if name in result.columns]
    some = F.lit(False)
    for name in arrays:
        some = some | (F.coalesce(F.size(F.col(name)), F.lit(0)) > 0)
    return some
