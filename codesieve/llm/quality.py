"""Quality scores by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text is the histogram of its hashed byte trigrams (case and punctuation count), and of the shapes of its words
and lines; counts are damped, weighted by inverse document frequency over *all* texts, and projected on the leading singular vectors of
the labelled sample.  The sample's latent vectors are broadcast; every text's cosine with every one
of them is computed exactly, in blocks, and the nearest labelled texts vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import mix, text_bytes, text_steps, windows_sql, word_bounds, word_hashes

#: Labelled texts in the sample, and the characters taken from each: the broadcast is bounded by these.
SAMPLE, SAMPLE_CHARS = 6_000, 50_000
BINS, RANK, NEIGHBOURS = 4096, 48, 15
#: Bins that a repeated word fills.
ECHO = 64
#: Rounds of subspace iteration, and the columns it carries beyond the rank.
ROUNDS, SPARE = 24, 16
#: Rows of one block of histograms and cosines.
BLOCK = 512

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
_NOT_FEED = np.ones(256, bool)
_NOT_FEED[10] = False


def histograms(part: pa.RecordBatch) -> np.ndarray:
    """Damped counts of the hashed features, texts x BINS."""
    data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
    n = part.num_rows
    code = data.astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    tri = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:] if len(code) > 2 else code[:0]
    inside = row[:-2] == row[2:] if len(code) > 2 else np.zeros(0, bool)
    cells = [(row[:-2][inside] if len(code) > 2 else row[:0]) * BINS + (mix(tri[inside]) >> np.uint64(40)).astype(np.int64) % BINS]
    for kind, (mask, salt) in enumerate(((_NOT_SPACE, 0x77), (_NOT_FEED, 0x99))):
        starts, ends, first = word_bounds(data, offsets, mask)
        of = np.repeat(np.arange(n), np.diff(first))
        size = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.int64), 12)
        upper = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else size[:0].astype(bool)
        closing = data[ends - 1].astype(np.int64) if len(starts) else size
        shape = size + 16 * upper + 64 * np.where(closing < 128, closing, 128) + 65536 * kind
        cells.append(of * BINS + (mix(shape.astype(np.uint64) + np.uint64(salt)) >> np.uint64(40)).astype(np.int64) % BINS)
        if kind == 0:  # words that repeat the one before: rare in prose, so they fill a band of bins
            names = word_hashes(data, starts, ends)
            echo = np.flatnonzero((names[1:] == names[:-1]) & (of[1:] == of[:-1])) + 1
            cells.append((of[echo][:, None] * BINS + np.arange(32, 32 + ECHO)[None, :]).ravel())
        # How often words or lines come back in the same text.
        names = word_hashes(data, starts, ends) ^ mix(of.astype(np.uint64) + np.uint64(salt))
        _, at, often = np.unique(names, return_index=True, return_counts=True)
        again = of[at][often > 2] if kind == 0 else of[at][often > 1]
        cells.append(again * BINS + 17 + kind)
    counts = np.bincount(np.concatenate(cells), minlength=n * BINS).reshape(n, BINS)
    return np.log1p(counts).astype(np.float32)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, for each bin, of texts that have it, over all rows (column ``text``)."""

    def step(batches):
        total, having = 0, np.zeros(BINS, np.int64)
        for batch in batches:
            for part in text_steps(batch, limit=1 << 20, rows=BLOCK):
                having += (histograms(part) > 0).sum(axis=0)
                total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(np.append(having, total))], names=["bin", "n"])

    rows = docs.select("text").mapInArrow(step, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r.bin] = r.n
    return int(out[BINS]), out[:BINS]


@dataclass
class Space:
    idf: np.ndarray  # BINS
    axes: np.ndarray  # BINS x rank
    vectors: np.ndarray  # labelled texts x rank, unit length
    labels: np.ndarray  # 0 or 1

    def place(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_axes(blocks: list[np.ndarray], rank: int, seed: int = 7) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the stacked blocks, BINS x rank, by subspace iteration: beside the
    blocks only BINS x (rank + SPARE) numbers are held, never the blocks' BINS x BINS products."""
    q = np.random.default_rng(seed).standard_normal((BINS, min(BINS, rank + SPARE))).astype(np.float32)

    def squared(q: np.ndarray) -> np.ndarray:
        out = np.zeros(q.shape)
        for x in blocks:
            out += x.T @ (x @ q)
        return out

    for _ in range(ROUNDS):
        q = np.linalg.qr(squared(q))[0].astype(np.float32)
    turn = np.linalg.eigh(q.T.astype(np.float64) @ squared(q))[1][:, ::-1]
    return (q @ turn[:, :rank]).astype(np.float32)


def fit(labelled: list[tuple[str, int]], total: int, having: np.ndarray, rank: int = RANK) -> Space:
    """Latent space of the labelled texts: truncated singular vectors of their weighted unit histograms."""
    idf = np.log((1 + total) / (1 + having)).astype(np.float32) + np.float32(0.1)
    blocks = []
    for part in text_steps(pa.RecordBatch.from_arrays([pa.array([t for t, _ in labelled], pa.string())], names=["text"]), limit=1 << 20, rows=BLOCK):
        x = histograms(part)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        blocks.append(x)
    rank = min(rank, len(labelled))
    axes = leading_axes(blocks, rank)
    vectors = np.concatenate([x @ axes for x in blocks]) if blocks else np.zeros((0, rank), np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Space(idf, axes, vectors, np.array([y for _, y in labelled], np.float32))


def vote(space: Space, vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the k nearest labelled texts, weighted by cosine; ties go to the earlier one.
    Without any labelled text the score is 0.5."""
    out = np.full(len(vectors), 0.5)
    k = min(k, len(space.labels))
    if not k:
        return out
    for lo in range(0, len(vectors), BLOCK):
        cosine = vectors[lo:lo + BLOCK] @ space.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** 4 + 1e-9
        out[lo:lo + BLOCK] = (weight * space.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> Space:
    """Fit on at most ``sample`` labelled texts, drawn by a hash of the id among those with a text; of longer ones
    windows of ``max_chars`` characters in all are taken.  Document frequencies cover all of ``docs``.  Null ids, texts and labels are left out of the sample;
    of several labels of one id the least counts."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = texts.where("text is not null")
    drawn = marks.join(usable.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)  # at most ``sample`` ids are sent to the texts
    chosen = usable.withColumn("text", F.expr(windows_sql("text", max_chars))).join(F.broadcast(drawn), "id")
    rows = chosen.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").collect()
    total, having = frequencies(texts)
    return fit([(r.text, r.y) for r in rows], total, having)


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text counts as empty.  Empty texts lie at the origin and so
    get the average vote of their nearest in order; ids may be null or repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(space)  # sample x rank and BINS x rank numbers: bounded
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def step(batches):
        own = sent.value
        for batch in batches:
            for part in text_steps(batch, limit=1 << 20, rows=BLOCK):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vote(own, own.place(histograms(part))))], names=["id", "score"])

    return texts.mapInArrow(step, "id bigint, score double")
