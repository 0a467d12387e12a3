"""Repeated lines and blocks, within a file and across the files of a batch.

Within a file everything happens inside its row (sort, find runs), without a shuffle.  Across
files only (batch, block hash, file, line) rows are shuffled, never text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve.functions import text
from codesieve.operators.findings import as_findings
from codesieve.operators.skew import SALTS, salt_of

KEYS = ["batch_id", "file_ord", "path"]
_LINE_RANGE = 2**31
#: Bits (as a power of two) of the table of shared blocks: 16 MB; bits of one of its rows.
BLOOM_BITS, _WORD_BITS = 27, 32_768
_SIZES = ["_min_lines", "_min_chars"]


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def _runs(items: Column) -> Column:
    """Group an array of struct(k, line, ...) into arrays with equal k, each ordered by line."""

    def of_sorted(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        heads = F.filter(positions, lambda i: (i == 0) | (s[i]["k"] != s[i - 1]["k"]))
        return _let(heads, lambda h: F.transform(
            h, lambda r, n: F.slice(s, r + 1, F.coalesce(F.get(h, n + 1), F.size(s)) - r)))

    return F.when(F.size(items) > 0, _let(F.sort_array(items), of_sorted))


def _repeats(items: Column, shown) -> Column:
    """All items after the first of their run, with the line of the first and a text to show."""
    later = F.transform(
        F.filter(_runs(items), lambda run: F.size(run) > 1),
        lambda run: F.transform(
            F.slice(run, F.lit(2), F.size(run) - 1),
            lambda e: F.struct(e["line"].alias("line"), run.getItem(0)["line"].alias("original_line"), shown(e).alias("s"))),
    )
    has_any = F.size(F.array_distinct(F.transform(items, lambda e: e["k"]))) < F.size(items)
    return F.when(has_any, F.flatten(later))


def _with_lines(files: DataFrame, min_chars: int | Column = 0) -> DataFrame:
    """File keys, block sizes that are columns, and ``lines``, stripped at their right ends; files shorter than ``min_chars`` get none."""
    lines = F.transform(text.split_lines(F.col("code")), text.rstrip)
    short = isinstance(min_chars, Column) or min_chars
    return files.select(*KEYS, *[c for c in _SIZES if c in files.columns], F.when(F.length("code") >= min_chars, lines).alias("lines") if short else lines.alias("lines"))


def _sized(files: DataFrame, min_lines: int | Column, min_chars: int | Column) -> tuple[DataFrame, int | Column, int | Column]:
    """Block sizes that differ by file become columns of the files."""
    sizes = []
    for name, size in zip(_SIZES, (min_lines, min_chars)):
        if isinstance(size, Column):
            files, size = files.withColumn(name, size.cast("int")), F.col(name)
        sizes.append(size)
    return files, *sizes


def _line_items(lines: Column) -> Column:
    keyed = F.transform(lines, lambda x, i: F.struct(text.lstrip(x).alias("k"), (i + 1).alias("line")))
    return F.filter(keyed, lambda e: e["k"] != "")


def _block(lines: Column, line: Column, width: Column) -> Column:
    """Text of the block of ``width`` lines that starts at a line; lines come stripped at their right ends.

    The right end needs a look only after an empty last line: it costs a walk over the whole block.
    """
    return _let(F.array_join(F.slice(lines, line, width), "\n"), lambda b: F.when(
        F.element_at(lines, (line + width - 1).cast("int")) != "", text.lstrip(b)).otherwise(text.strip(b)))


def _block_hashes(lines: Column, min_lines: int | Column, min_chars: int | Column) -> Column:
    """64-bit hash of every full window, null for those that are too short."""
    width = F.lit(min_lines)

    def hashes(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(lines) - width + 1), lambda i: _let(
            _block(lines, i, width), lambda b: F.when(F.length(b) >= min_chars, F.xxhash64("batch_id", b))))

    return F.when(F.size(lines) >= width, hashes(lines))


def _some_block_items(lines: Column, min_lines: int | Column, chosen: Column) -> Column:
    """The items of the windows whose numbers (from 0) are ``chosen``."""
    width = F.lit(min_lines)
    return F.transform(chosen, lambda i: _let(_block(lines, i + 1, width), lambda b: F.struct(
        F.unhex(F.sha2(b, 256)).alias("k"), (i + 1).alias("line"), text.snippet(b, 80).alias("s"))))


def _block_items(lines: Column, min_lines: int | Column, min_chars: int | Column) -> Column:
    """struct(k = hash, line, s = snippet) of every full window that is long enough."""
    width = F.lit(min_lines)

    def windows(lines: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(lines) - width + 1)
        blocks = F.transform(starts, lambda i: _let(
            _block(lines, i, width),
            lambda b: F.when(F.length(b) >= min_chars, F.struct(
                F.unhex(F.sha2(b, 256)).alias("k"), i.alias("line"), text.snippet(b, 80).alias("s")))))
        return F.filter(blocks, lambda b: b.isNotNull())

    # sequence() would count downwards when the file is shorter than one window
    return F.when(F.size(lines) >= width, windows(lines))


def _emit(files: DataFrame, repeats: Column) -> DataFrame:
    # outer: keeps the optimizer from copying the array expression into a size() > 0 filter
    return files.select(*KEYS, repeats.alias("hits")).select(*KEYS, F.inline_outer("hits")).where("line is not null")


_LINE = {"detector": "ip_duplication", "ord": 3, "message": "Possible duplicate or copied code detected."}
_BLOCK = {"detector": "ip_near_duplicate", "ord": 4, "message": "Possible near-duplicate code block detected."}


def _line_repeats(items: Column) -> Column:
    return _repeats(items, lambda e: text.snippet(e["k"], 60))


def _block_repeats(items: Column) -> Column:
    return _repeats(items, lambda e: e["s"])


def _repeated(rows: DataFrame, what: dict) -> DataFrame:
    return as_findings(
        rows, family="license_ip", detector=what["detector"], detector_ord=what["ord"], rule_ord=1, pattern_ord=1,
        type=what["detector"], message=what["message"], snippet=F.col("s"), severity="warning")


def duplicate_lines(files: DataFrame) -> DataFrame:
    """Later copies of a stripped, non-empty line of the same file."""
    items = _with_lines(files).select(*KEYS, _line_items(F.col("lines")).alias("items"))
    return _repeated(_emit(items, _line_repeats(F.col("items"))), _LINE)


def near_duplicate_blocks(files: DataFrame, min_lines: int | Column = fv.BLOCK_MIN_LINES, min_chars: int | Column = fv.BLOCK_MIN_CHARS) -> DataFrame:
    """Later copies of a block of ``min_lines`` lines in the same file."""
    files, min_lines, min_chars = _sized(files, min_lines, min_chars)
    items = _with_lines(files, min_chars).select(*KEYS, _block_items(F.col("lines"), min_lines, min_chars).alias("items"))
    return _repeated(_emit(items, _block_repeats(F.col("items"))), _BLOCK)


def within_file_duplicates(files: DataFrame, min_lines: int | Column = fv.BLOCK_MIN_LINES, min_chars: int | Column = fv.BLOCK_MIN_CHARS) -> DataFrame:
    """Repeated lines and blocks of a file in one pass over the text; block sizes may be columns of the files."""
    files, min_lines, min_chars = _sized(files, min_lines, min_chars)
    items = _with_lines(files).select(
        *KEYS, _line_items(F.col("lines")).alias("single"), _block_items(F.col("lines"), min_lines, min_chars).alias("blocks"))

    def marked(found: Column, is_block: bool) -> Column:
        return F.transform(F.coalesce(found, F.array()), lambda e: F.struct(
            F.lit(is_block).alias("block"), e["line"].alias("line"), e["original_line"].alias("original_line"), e["s"].alias("s")))

    both = F.concat(marked(_line_repeats(F.col("single")), False), marked(_block_repeats(F.col("blocks")), True))
    rows = _emit(items, both)

    def pick(name: str) -> Column:
        return F.when(F.col("block"), _BLOCK[name]).otherwise(_LINE[name])

    return as_findings(
        rows, family="license_ip", detector=pick("detector"), detector_ord=pick("ord"), rule_ord=1, pattern_ord=1,
        type=pick("detector"), message=pick("message"), snippet=F.col("s"), severity="warning")


def superseded_paths(files: DataFrame) -> DataFrame:
    """Paths that occur more than once in a batch: first position and the order of the last copy."""
    return (
        files.select(*KEYS).groupBy("batch_id", "path")
        .agg(F.min("file_ord").alias("first_ord"), F.max("file_ord").alias("last_ord"))
        .where("first_ord < last_ord")
    )


def _hashed(files: DataFrame, min_lines: int | Column, min_chars: int | Column) -> DataFrame:
    """File keys, lines, and the hash of every block."""
    files, min_lines, min_chars = _sized(files, min_lines, min_chars)
    return _with_lines(files, min_chars).withColumn("hashes", _block_hashes(F.col("lines"), min_lines, min_chars))


def shared_block_bits(files: DataFrame, min_lines: int | Column = fv.BLOCK_MIN_LINES, min_chars: int | Column = fv.BLOCK_MIN_CHARS, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bit table of the hashes of blocks that occur in two files of a batch: ``2**bits`` bits on the driver.

    Only (hash, least and greatest position) are shuffled, after partial aggregation; files whose path occurs again
    count too, so a bit may be set in vain, but none is missing.
    """
    pairs = _hashed(files, min_lines, min_chars).select("file_ord", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("h"))
    shared = pairs.groupBy("h").agg(F.min("file_ord").alias("lo"), F.max("file_ord").alias("hi")).where("lo < hi")
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    words = shared.select(F.floor(place / _WORD_BITS).alias("word"), (place % _WORD_BITS).alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in words.toLocalIterator():  # at most 2**bits bits
        at = row.word * _WORD_BITS // 8
        table[at:at + len(row.bits)] = np.frombuffer(bytes(row.bits), np.uint8)[:len(table) - at]
    return table


def _chosen(sent, bits: int) -> partial:
    """A step over files that keeps those with a block whose bit is set: ``hashes``, the last column, gives way to the places of those blocks (``chosen``).

    A step of its own, not a column: the optimizer would copy the column, and the cutting and hashing below it, into each filter and use.
    """
    return partial(_with_chosen, sent, bits)


def _with_chosen(sent, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = sent.value
    for batch in batches:
        hashes = batch.column(batch.num_columns - 1)
        lengths = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten()
        at = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
        hit = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & pc.is_valid(flat).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        inner = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        counts = np.bincount(row[hit], minlength=len(lengths))
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(inner[hit], pa.int32()))
        own = batch.select(range(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*own.columns, places], names=[*own.schema.names, "chosen"]).filter(pa.array(counts > 0))


def file_blocks(files: DataFrame, min_lines: int | Column = fv.BLOCK_MIN_LINES, min_chars: int | Column = fv.BLOCK_MIN_CHARS, shared_only: bool = False,
                bits: int = BLOOM_BITS) -> DataFrame:
    """One narrow row per distinct block of a file: hash, all lines where it starts, snippet.

    With ``shared_only``, blocks that are surely in one file of their batch only are left out; a job over the files finds the others first.
    """
    if shared_only:
        table = shared_block_bits(files, min_lines, min_chars, bits)
        if not table.any():
            shared_only, files = False, files.where(F.lit(False))
        else:
            hashed = _hashed(files, min_lines, min_chars)
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashed.drop("hashes").schema) + ", chosen array<int>"
            found = hashed.mapInArrow(_chosen(files.sparkSession.sparkContext.broadcast(table), bits), kinds)  # 2**bits bits
            width = F.col("_min_lines") if "_min_lines" in hashed.columns else min_lines
            items = found.withColumn("items", _some_block_items(F.col("lines"), width, F.col("chosen")))
    if not shared_only:
        files, min_lines, min_chars = _sized(files, min_lines, min_chars)
        items = _with_lines(files, min_chars).withColumn("items", _block_items(F.col("lines"), min_lines, min_chars))
    items = items.select(*KEYS, "items")
    grouped = F.transform(_runs(F.col("items")), lambda run: F.struct(
        run.getItem(0)["k"].alias("k"), F.transform(run, lambda e: e["line"]).alias("lines"), run.getItem(0)["s"].alias("s")))
    return items.select(*KEYS, grouped.alias("b")).select(*KEYS, F.inline_outer("b")).where("k is not null")


def cross_file_duplicates(files: DataFrame, min_lines: int | Column = fv.BLOCK_MIN_LINES, min_chars: int | Column = fv.BLOCK_MIN_CHARS,
                          unique_paths: bool = False, salts: int = SALTS, two_pass: bool = False, bits: int = BLOOM_BITS) -> DataFrame:
    """Copies of a block that first occurs in another file of the batch.

    Order is (position of the file, line).  When a path occurs twice in a batch, its last text
    counts, at its first position; pass ``unique_paths=True`` when that cannot happen.

    A boilerplate block may occur in a third of all files.  First occurrences are therefore
    aggregated per (block, salt) before they meet per block, where at most ``salts`` rows remain,
    and the join back runs on (block, salt).  Both read one exchange of the blocks, so the text is cut once.

    With ``two_pass``, a first pass shuffles 64-bit hashes and positions only and leaves a table of ``2**bits`` bits of the blocks in
    two files; hashes, lines and snippets of the others then never move.  It reads and cuts the text once more, so it pays
    where the shuffle is the bottleneck and most blocks are in one file only.
    """
    blocks = file_blocks(files, min_lines, min_chars, two_pass, bits)
    blocks = blocks.withColumn("pos", F.col("file_ord"))
    if not unique_paths:
        twice = superseded_paths(files)
        blocks = (
            blocks.join(twice, ["batch_id", "path"], "left")
            .where("last_ord is null or file_ord = last_ord")
            .withColumn("pos", F.coalesce("first_ord", "file_ord")).drop("first_ord", "last_ord")
        )
    # One exchange serves the aggregate and the join back only if both ask the same of it: filters that the join would add on its
    # side stand here (it loses such rows anyway) or are forms that add none, and both use every column (``used``, ``at_least``).
    blocks = blocks.withColumn("salt", salt_of("file_ord", salts)).where("batch_id is not null and salt is not null")
    blocks = blocks.select(*KEYS, "k", "lines", "s", "pos", "salt").repartition("batch_id", "k", "salt")
    # (position, line) as one fixed-width number: strings and structs would force a sort before the shuffle
    place = F.col("pos").cast("decimal(20,0)") * F.lit(_LINE_RANGE).cast("decimal(11,0)") + F.element_at("lines", 1)
    partial = blocks.groupBy("batch_id", "k", "salt").agg(
        F.min(place.cast("decimal(38,0)")).alias("first"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.max(F.xxhash64(*KEYS, "lines", "s")).alias("used")).where("used is not null")
    block = Window.partitionBy("batch_id", "k")
    shared = partial.select(
        "batch_id", "k", "salt", F.min("first").over(block).alias("first"), F.min("lo").over(block).alias("pos"),
        F.max("hi").over(block).alias("hi")).where("pos < hi")
    names = files.select("batch_id", F.col("file_ord").alias("pos"), F.col("path").alias("original_file"))
    originals = shared.join(names, ["batch_id", "pos"]).select(
        "batch_id", "k", "salt", F.col("pos").alias("at_least"), "original_file",
        (F.col("first") - F.col("pos").cast("decimal(20,0)") * F.lit(_LINE_RANGE).cast("decimal(11,0)")).cast("int").alias("original_line"))
    copies = (
        blocks.join(originals, ["batch_id", "k", "salt"])
        .where(F.coalesce((F.col("path") != F.col("original_file")) & F.coalesce(F.col("pos") >= F.col("at_least"), F.lit(True)), F.lit(False)))
        .select(*KEYS, F.explode_outer("lines").alias("line"), "original_file", "original_line", "s")
    )
    return as_findings(
        copies, family="license_ip", detector="ip_cross_file_duplicate", detector_ord=5, rule_ord=1, pattern_ord=1,
        type="ip_cross_file_duplicate", message="Possible duplicated code block across files.", snippet=F.col("s"),
        severity="warning")
