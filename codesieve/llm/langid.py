"""Language identification with a linear-chain conditional random field over words.

Every word of a text is labelled; neighbouring labels are tied by learned transitions, so runs in one
language hold together and a text may switch.  A word's features are hashed: its trigrams with
borders, its first and its last four bytes (affixes), and the word itself (lexicon).  Training
maximises the likelihood of a bounded sample of labelled texts, joined three by three so that switches occur; prediction
takes each word's marginals from forward-backward.  Messages are passed over blocks of words as products
of transfer matrices, so one long text costs as many steps as its blocks, not as its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import ascii_lower, mix, text_bytes, text_sample, text_steps, windows_sql, word_bounds, word_hashes

#: Labelled texts per language in the sample, and the characters taken from each: what the driver holds is bounded.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
FEATURES = 1 << 16
BLOCK = 32
#: Text bytes that are labelled at a time: each byte is a trigram of several 8-byte numbers.
LABEL_BYTES = 1 << 19
#: Label of texts that are null or have no letter.
UNKNOWN = "und"

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    switch: np.ndarray  # labels x labels, log


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, flat, and the index of each word's first one (n + 1 values)."""
    sizes = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    if not len(starts):
        return bounds[:0], bounds
    np.cumsum(sizes + 3, out=bounds[1:])
    slot = np.full(int(bounds[-1]), 0, np.uint64)
    inner = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(3 * np.arange(len(starts)), sizes)
    at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    code = data.astype(np.uint64)
    before = np.where(at > np.repeat(starts, sizes), code[np.maximum(at - 1, 0)], 0)
    after = np.where(at < np.repeat(ends - 1, sizes), code[np.minimum(at + 1, len(code) - 1)], 0)
    slot[inner] = (before << np.uint64(16)) | (code[at] << np.uint64(8)) | after
    head, tail = np.minimum(starts + 4, ends), np.maximum(ends - 4, starts)
    last = bounds[1:] - 1
    slot[last - 2] = word_hashes(data, starts, head) ^ np.uint64(0x1111)
    slot[last - 1] = word_hashes(data, tail, ends) ^ np.uint64(0x2222)
    slot[last] = word_hashes(data, starts, ends) ^ np.uint64(0x3333)
    return (mix(slot + np.uint64(0x51ED270B)) >> np.uint64(48)).astype(np.int64) % FEATURES, bounds


def emissions(tagger: Tagger, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log potentials of words x labels."""
    if len(bounds) == 1:
        return np.zeros((0, len(tagger.labels)))
    return np.stack([np.add.reduceat(w[ids], bounds[:-1]) for w in tagger.weights.T.astype(np.float64)], axis=1)


def marginals(emission: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word by forward-backward, and the forward messages; ``counts`` are
    the words of each sequence.

    A sequence is cut into blocks.  Each block's transfer matrix is a product over its words, all blocks at a
    time; the messages at block borders go from block to block of a sequence, all sequences at a time; then
    the words of all blocks get theirs.
    """
    k = emission.shape[1]
    per = -(-counts // BLOCK)
    n_blocks = int(per.sum())
    if not n_blocks:
        return np.zeros_like(emission), np.zeros_like(emission)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    sequence = np.repeat(np.arange(len(counts)), per)
    inside = np.arange(n_blocks) - first[sequence]
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])[sequence] + inside * BLOCK
    size = np.minimum(counts[sequence] - inside * BLOCK, BLOCK)
    potential = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(switch - switch.max())
    index = base[:, None] + np.minimum(np.arange(BLOCK)[None, :], size[:, None] - 1)
    valid = np.arange(BLOCK)[None, :] < size[:, None]
    local = potential[index]  # blocks x BLOCK x k

    transfer = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for t in range(BLOCK):
        moved = (transfer @ step) * local[:, t, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(valid[:, t, None, None], moved, transfer)
    enter = np.full((n_blocks, k), 1.0 / k)
    leave = np.ones((n_blocks, k))
    for t in range(1, int(per.max())):
        own = first[per > t] + t
        message = np.einsum("bi,bij->bj", enter[own - 1], transfer[own - 1])
        enter[own] = message / message.sum(axis=1, keepdims=True)
    for t in range(int(per.max()) - 2, -1, -1):
        own = first[per > t + 1] + t
        message = np.einsum("bij,bj->bi", transfer[own + 1], leave[own + 1])
        leave[own] = message / message.sum(axis=1, keepdims=True)
    forward = np.empty((n_blocks, BLOCK, k))
    message = enter
    for t in range(BLOCK):
        moved = (message @ step) * local[:, t]
        message = np.where(valid[:, t, None], moved / moved.sum(axis=1, keepdims=True), message)
        forward[:, t] = message
    out, ahead = np.empty_like(emission), np.empty_like(emission)
    message = leave
    for t in range(BLOCK - 1, -1, -1):
        own = valid[:, t]
        both = forward[own, t] * message[own]
        out[base[own] + t] = both / both.sum(axis=1, keepdims=True)
        ahead[base[own] + t] = forward[own, t]
        moved = (local[:, t] * message) @ step.T
        message = np.where(own[:, None], moved / moved.sum(axis=1, keepdims=True), message)
    return out, ahead


def pair_counts(counts: np.ndarray, post: np.ndarray, forward: np.ndarray, switch: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Observed less expected transitions: the joint of two neighbours is the forward message of the first, the
    transition, and the second's marginal over what the forward message predicts for it."""
    same = np.repeat(np.arange(len(counts)), counts)
    inner = np.flatnonzero(same[:-1] == same[1:])
    seen, step = np.zeros_like(switch), np.exp(switch)
    np.add.at(seen, (labels[inner], labels[inner + 1]), 1.0)
    ratio = post[inner + 1] / np.maximum(forward[inner] @ step, 1e-300)
    return seen - step * (forward[inner].T @ ratio)


def train(texts: list[tuple[str, str]], rounds: int = 4, rate: float = 0.5, seed: int = 7) -> Tagger:
    """Fit a tagger on (text, language) pairs by stochastic gradients with adaptive steps."""
    labels = sorted({lang for _, lang in texts})
    k = len(labels)
    tagger = Tagger(labels, np.zeros((FEATURES, k), np.float32), np.full((k, k), -2.0) + 2.0 * np.eye(k))
    if not texts:
        return tagger
    order = np.random.default_rng(seed).permutation(len(texts))
    squares, groups = np.zeros_like(tagger.weights), [order[i:i + 30] for i in range(0, len(order), 30)]
    for turn in range(rounds):
        for group in groups:
            data, offsets = text_bytes(pa.array([texts[i][0] for i in group], pa.string()))
            data = ascii_lower(data)
            starts, ends, first = word_bounds(data, offsets, _LETTERS)
            if not len(starts):
                continue
            counts = np.diff(first)
            truth = np.repeat([labels.index(texts[i][1]) for i in group], counts)
            counts = np.add.reduceat(counts, np.arange(0, len(counts), 3))  # three texts are one sequence
            ids, bounds = features(data, starts, ends)
            emission = emissions(tagger, ids, bounds)
            post, ahead = marginals(emission, counts[counts > 0], tagger.switch)
            error = -post
            error[np.arange(len(truth)), truth] += 1.0
            owner = np.repeat(np.arange(len(starts)), np.diff(bounds))
            gradient = np.stack([np.bincount(ids, error[owner, j], FEATURES) for j in range(k)], axis=1) / len(group)
            squares += gradient**2
            tagger.weights += (rate * gradient / (np.sqrt(squares) + 1.0)).astype(np.float32)
            tagger.switch += rate / (1 + turn) / len(truth) * pair_counts(counts[counts > 0], post, ahead, tagger.switch, truth)
    return tagger


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
        max_chars: int = SAMPLE_CHARS) -> Tagger:
    """Train on at most ``per_language`` labelled texts of each language, chosen by a hash of the text; of
    longer ones windows of ``max_chars`` characters in all are taken.  Rows with a null text or language are left out."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("text", F.expr(windows_sql("text", max_chars)))
    return train([(r.text, r.lang) for r in text_sample(rows, per_language, ["lang"]).orderBy("lang", "h").collect()])


def label_texts(tagger: Tagger, part: pa.RecordBatch, column: str = "text"):
    """For each row (its text in ``column``): mean label probabilities, number of words, and every word's label."""
    data, offsets = text_bytes(part.column(part.schema.get_field_index(column)))
    data = ascii_lower(data)
    starts, ends, first = word_bounds(data, offsets, _LETTERS)
    counts = np.diff(first)
    ids, bounds = features(data, starts, ends)
    post, _ = marginals(emissions(tagger, ids, bounds), counts[counts > 0], tagger.switch)
    sums = np.zeros((len(post) + 1, len(tagger.labels)))
    np.cumsum(post, axis=0, out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts, 1)[:, None], counts, post.argmax(axis=1) if len(post) else post, first


def predict(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
            word_labels: bool = False) -> DataFrame:
    """The ``keep`` columns (the id by default) with ``lang_pred`` and ``score``, the mean probability of that
    language over the words, and with ``word_langs``, a label for each word, if asked for.

    Null and empty texts and texts without a letter get ``und`` with score 0, as does every text if
    nothing was learned; ids may be null or repeat; ties go to the first language by name.
    """
    names = keep or [id_col]
    if not tagger.labels:
        nothing = [F.array().cast("array<string>").alias("word_langs")] if word_labels else []
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *nothing)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # FEATURES x labels numbers: a fixed size
    with_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept goes to Python once
    kept_text = names.index(text_col) if text_col in names and docs.schema[text_col].dataType.simpleString() == "string" else None
    seen = "text" if kept_text is None else f"c{kept_text}"
    own_text = [F.col(text_col).cast("string").alias("text")] if kept_text is None else []
    frame = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], with_letter.alias("letters"), *own_text)
    kept = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]

    def step(batches):
        own = sent.value
        for batch in batches:
            for part in text_steps(batch, seen, LABEL_BYTES):
                letters = part.column(len(names)).to_numpy(zero_copy_only=False)
                means, counts, best, first = label_texts(own, part, seen)
                known = letters & (counts > 0)
                top = means.argmax(axis=1)
                langs = [own.labels[j] if ok else UNKNOWN for j, ok in zip(top, known, strict=True)]
                score = np.where(known, np.minimum(means.max(axis=1), 1.0), 0.0)
                cols = [part.column(i) for i in range(len(names))] + [pa.array(langs, pa.string()), pa.array(score)]
                if word_labels:
                    cols.append(pa.array([[own.labels[j] for j in best[first[i]:first[i + 1]]] for i in range(part.num_rows)], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(cols, names=[f"x{i}" for i in range(len(cols))])

    out = frame.mapInArrow(step, ", ".join(kept) + ", lang_pred string, score double" + (", word_langs array<string>" if word_labels else ""))
    return out.toDF(*names, "lang_pred", "score", *(["word_langs"] if word_labels else []))
