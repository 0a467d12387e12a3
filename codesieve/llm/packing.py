"""Packing along a space-filling curve.

Every document becomes a hashed vector of its tokens (square roots of bucket counts, unit length), which a fixed
random matrix projects to a few dimensions.  Scaled by mean and deviation of all rows, the projections name a cell of
a grid, and the cell's place on the Hilbert curve is the document's key.  The rows are range-sorted by key, each task
sums its token counts, the tasks' totals give every row its place in the one stream of tokens, and the stream is
cut into sequences of the given length: neighbours on the curve share a sequence.  What is left over at the
end becomes sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.bpe import PATTERN, Coder, Model, byte_letters
from codesieve.llm.common import mix, text_steps, written

#: Buckets of the hashed vector; dimensions it is projected to and bits of each of them in the key.
BUCKETS, DIMENSIONS, BITS = 1024, 6, 10
#: Ids that one stored row holds; a longer document takes several rows.
ROW_IDS = 1 << 16
#: Characters after which a long text is cut, at the next single blank between two other characters.
PIECE = 1 << 20
_BLANK = regex.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of a byte-level BPE file whose ids are in the order of its merges."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level models")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError("only models with ids in the order of their merges")
        self._content, self._slow = content, None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self._coding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*vocab.values(), *special.values()]) + 1

    def ids(self, text: str) -> np.ndarray:
        found, at = [], 0
        while len(text) - at > PIECE:
            cut = _BLANK.search(text, at + PIECE)
            if not cut:
                break
            found.append(self._piece(text[at:cut.start()]))
            at = cut.start()
        found.append(self._piece(text[at:]))
        return np.concatenate(found) if len(found) > 1 else found[0]

    def _piece(self, text: str) -> np.ndarray:
        try:
            return self._coding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on very long runs of white space
            self._slow = self._slow or Coder(Model(self._content))
            return np.array([i for ids in self._slow.encoded(text) for i in ids], np.uint32)


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


def hashed_vectors(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unit vectors of bucket counts' square roots, a row for each document; ``ends`` are running totals of ids."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    bucket = (mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int64)
    vectors = np.sqrt(np.bincount(row * BUCKETS + bucket, minlength=len(ends) * BUCKETS).reshape(len(ends), BUCKETS))
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of whole numbers below 2^bits) on the Hilbert curve, after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in x:
            turned = (axis & high) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> level) & 1)
    return key


def _encoded(content, end_id: int):
    """Tasks' step: rows of ids with the document's length and, on its first row, its projection."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, matrix = Encoder(content.value), _projection()
        kind = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_steps(batch, rows=1024):
                docs = [np.append(encoder.ids(t or ""), end_id).astype(kind) for t in part.column(1).to_pylist()]
                places = hashed_vectors(np.concatenate(docs), np.cumsum([len(d) for d in docs])) @ matrix
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, ids, place in zip(part.column(0).to_pylist(), docs, places.tolist(), strict=True):
                    number += 1
                    for at in range(0, len(ids), ROW_IDS):
                        for column, value in zip(out, (doc_id, number, at, len(ids), place, ids[at:at + ROW_IDS].tobytes()), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "number", "start", "total", "place", "ids"])

    return step


def _numbered(width: int):
    """Tasks' step over range-sorted rows: the task, and the ids before each row in it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) // width
            before = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), task, np.int32)), pa.array(before), *batch.columns],
                                             names=["task", "before", "id", "start", "total", "ids"])

    return step


def sequence_of(at: int, length: int, full: int, tails: list[int], end: int) -> tuple[int, int, int]:
    """Number, first place and end of the sequence that holds place ``at``: whole ones up to ``full``, then ``tails``."""
    if at < full:
        return at // length, at - at % length, at - at % length + length
    i = bisect_right(tails, at) - 1
    return full // length + i, tails[i], tails[i + 1] if i + 1 < len(tails) else end


def tail_starts(full: int, end: int) -> list[int]:
    """Starts of the sequences after the whole ones: one for each binary digit of what is left, greatest first."""
    starts, at = [], full
    for bit in range((end - full).bit_length() - 1, -1, -1):
        if (end - full) >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return starts


def _cut(firsts: dict[int, int], length: int, end: int, kind: type):
    full = end - end % length
    tails = tail_starts(full, end)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            task, before, doc_ids, starts, totals, binaries = (c.to_pylist() for c in batch.columns)
            for t, b, doc_id, start, total, data in zip(task, before, doc_ids, starts, totals, binaries, strict=True):
                ids = np.frombuffer(data, kind).astype("<u4")
                first = firsts[t] + b
                at = first
                while at < first + len(ids):
                    number, begin, stop = sequence_of(at, length, full, tails, end)
                    stop = min(stop, first + len(ids))
                    for column, value in zip(out, (doc_id, start + at - first, total, number, at - begin, ids[at - first:stop - first].tobytes()), strict=True):
                        column.append(value)
                    at = stop
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                             names=["id", "start", "doc_tokens", "sequence_id", "offset", "ids"])

    return step


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, doc_tokens, sequence_id, offset, ids) of every piece; ``ids`` are little-endian 32-bit numbers.

    ``path`` is a byte-level BPE file of the tokenizers library; ``end_id`` ends every document.  All sequences have
    ``length`` ids, but for at most log2(length) last ones, whose lengths are powers of two.  A null text is as an
    empty one: ``end_id`` alone.  Repeated rows and ids are documents of their own; null ids stay null.  A document's
    pieces end where a sequence ends, and after every 65,536 ids.  Only the number of ids in
    each task, and mean and deviation of the projections, come to the driver.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    kind = np.uint16 if max(Encoder(text).size, end_id + 1) <= 1 << 16 else np.uint32
    content = docs.sparkSession.sparkContext.broadcast(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = written(rows.mapInArrow(_encoded(content, end_id), "id bigint, number bigint, start bigint, total bigint, place array<double>, ids binary"))
    each = [F.col("place")[i] for i in range(DIMENSIONS)]
    scale = coded.where("start = 0").agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean = np.array([round(v or 0.0, 9) for v in scale[:DIMENSIONS]])
    spread = np.maximum([round(v or 0.0, 9) for v in scale[DIMENSIONS:]], 1e-9)

    @F.pandas_udf("bigint")
    def key(place):
        import pandas as pd

        z = (np.stack(place.to_numpy()) - mean) / spread if len(place) else np.zeros((0, DIMENSIONS))
        share = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # normal distribution, nearly
        return pd.Series(hilbert_keys(np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))

    order = ["key", "id", "number", "start"]
    ranged = coded.withColumn("key", key("place")).drop("place").repartitionByRange(*order).sortWithinPartitions(*order)
    width = np.dtype(kind).itemsize
    placed = written(ranged.select("id", "start", "total", "ids").mapInArrow(_numbered(width), "task int, before bigint, id bigint, start bigint, total bigint, ids binary"))
    firsts, end = {}, 0
    for task, n in placed.groupBy("task").agg(F.sum(F.octet_length("ids").cast("bigint")) / width).orderBy("task").collect():  # a row for each task
        firsts[task], end = end, end + int(n)
    return placed.mapInArrow(_cut(firsts, length, end, kind), "id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
