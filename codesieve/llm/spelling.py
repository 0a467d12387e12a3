"""Spelling variants by dense prefix-suffix tiles.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and common suffix
together reach the longer length minus one.  Tiles hold words as padded code-point matrices, once
aligned left and once right, and compare block with block, a column at a time, for all pairs of a tile at once.

A tile holds the words that can be near each other at all: if the edit lies in the second half of the longer word,
both share its first half, else its last half.  So a word stands under two halves for each of two longer lengths: its
own and one more.  Halves with very many words are cut into blocks, and each pair of blocks is a tile of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import written

#: Words of a half that stay one tile at least; and the most halves that may be cut, which is the bound of their broadcast.
TILE, MOST_CUT = 8192, 50_000
#: Words of a block in a tile, and the most code points of its matrix.
BLOCK, BLOCK_POINTS = 384, 1 << 22
#: Different words that a counting task holds before it sends them on.
HELD = 300_000
_PAD = 0x110000


def _counted(least: int, slips: int):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
                found = Counter(m.group() for m in run.finditer((text or "").encode().lower().decode()))
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), before) if slips else 1
                    if slips and h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield sent()
        yield sent()

    return step


def word_counts(docs: DataFrame, least: int = 7, occurrences: int = 2, slips: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``occurrences`` times in all texts.

    A word is a maximal run of ``[A-Za-zÀ-ÿ]``, A-Z in lower case.  Where ``slips`` divides the unsigned crc32 of
    ``<id>:<word>`` a code point is left out, the one at that number modulo the length; 0 leaves words as they are.
    Null texts have no words, a null id counts as an empty one; repeated rows count again.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counted = rows.mapInArrow(_counted(least, slips), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, a column of the matrix for each word; shorter words are padded at their end, or at their start."""
    padded = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).copy()
    short = np.array([len(w) < width for w in words])
    points[short, 0 if right else width - 1] = _PAD
    return np.ascontiguousarray(points.T)


def _common(points: np.ndarray, order: range, a: slice, b: slice, among: np.ndarray) -> np.ndarray:
    """For all pairs of two blocks, the number of equal leading columns in ``order``; 0 for pairs not ``among``."""
    alive, length = among.copy(), np.zeros(among.shape, np.int32)
    for k in order:
        alive &= points[k, a][:, None] == points[k, b][None, :]
        if not alive.any():
            break
        length += alive
    return length


def _tile_pairs(words: list[str], band: int, side: np.ndarray, group: np.ndarray, own: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near words among rows of one longer length ``band``; rows are in the order of ``group``."""
    left, right = _matrix(words, band, False), _matrix(words, band, True)
    whole = np.array([len(w) == band for w in words])
    step, half = max(1, min(BLOCK, BLOCK_POINTS // band)), band // 2
    found = [(np.zeros(0, np.int64),) * 2]
    for i in range(0, len(words), step):
        a = slice(i, min(i + step, len(words)))
        for j in range(i, len(words), step):
            if group[j] != group[a.stop - 1] and j > i:
                break
            b = slice(j, min(j + step, len(words)))
            among = (group[a][:, None] == group[b][None, :]) & (whole[a][:, None] | whole[b][None, :])
            among &= ~two[a][:, None] | (own[a][:, None] != own[b][None, :])
            if i == j:
                among = np.triu(among, 1)
            if not among.any():
                continue
            prefix = _common(left, range(band), a, b, among)
            among &= np.where(side[a][:, None] == 0, prefix >= half, prefix < half)  # a pair that shares both halves counts once
            suffix = _common(right, range(band - 1, -1, -1), a, b, among)
            x, y = np.nonzero(among & (prefix + suffix >= band - 1))
            found.append((x + i, y + j))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    return x, y


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, side, key, x, y, own, word, n), tile after tile: both directions of every near pair."""

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(_starts(rows)) - 1
        rows = rows.filter(pa.array(np.bincount(group)[group] > 1))  # tiles of one word
        if not len(rows):
            return
        first = np.flatnonzero(_starts(rows))
        group = np.cumsum(_starts(rows)) - 1
        band, side, x, y, own = (rows[c].to_numpy() for c in ("band", "side", "x", "y", "own"))
        words, counts = rows["word"].to_pylist(), rows["n"].to_numpy()
        block = first[group] // np.maximum(1, np.minimum(BLOCK, BLOCK_POINTS // band))  # whole tiles, about a block together
        edges = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(band, prepend=-1) != 0)).tolist() + [len(words)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = slice(lo, hi)
            i, j = _tile_pairs(words[part], int(band[lo]), side[part], group[part], own[part], (x != y)[part])
            if len(i):
                a, b = np.concatenate([i, j]) + lo, np.concatenate([j, i]) + lo
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in a.tolist()]), pa.array([words[k] for k in b.tolist()]), pa.array(counts[b])],
                                                 names=["word", "near", "near_n"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        last = int(np.flatnonzero(_starts(rows))[-1])
        yield from compared(rows.slice(0, last)) if last else ()
        held = rows.slice(last)
    if held is not None and len(held):
        yield from compared(held)


def _starts(rows: pa.Table) -> np.ndarray:
    """Marks the first row of each tile."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for name in ("key", "x", "y"):
        column = rows[name].to_numpy()
        out[1:] |= column[1:] != column[:-1]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) in both directions of all pairs of ``words`` (word, n; each word once) that differ by one code point."""
    length = F.length("word")
    bands = words.withColumn("band", F.explode(F.array(length, length + 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.expr("CASE side WHEN 0 THEN left(word, band div 2) ELSE right(word, band - band div 2) END")
    keyed = bands.withColumn("key", F.xxhash64("band", "side", half))
    total = words.count()
    limit = max(TILE, -(-4 * total // MOST_CUT))  # at most MOST_CUT halves have more words than this
    large = keyed.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    placed = keyed.join(F.broadcast(large), "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.lit(0)))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    tiled = tiled.select("band", "side", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "word", "n")
    tiles = tiled.repartition("key", "x", "y").sortWithinPartitions("band", "key", "x", "y")
    return tiles.mapInArrow(_near, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the way is followed with steps of doubling length; it has at most 19 words, as counts grow tenfold."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    ``form`` is the near word (one code point inserted, deleted or replaced) that occurs most often, of equally frequent
    ones the least in code-point order, if it occurs at least ``times`` (2 or more) as often as the word; else it is null, as
    ``form_n`` is.  ``root`` is the last word on the way from form to form, the word itself if it has none.
    Null and empty words are left out; repeated words are added up.  Halves are told apart by 64-bit hashes, which can only
    add comparisons.  Words may be of any length.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    vocabulary = written(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("bigint").alias("n")).where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    best = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    frequent = -F.col("best.less") >= times * F.col("n")
    named = written(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
