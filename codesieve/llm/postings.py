"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores one row per (segment, term) with the term's word positions.  A segment is a bounded
run of texts of one task; positions count through the segment with a gap of one between texts, so
a phrase cannot cross from one text into the next.  ``matches`` asks the index for phrases: it takes the
test terms' rows only, brings the rows of one segment together, and for each window intersects the lists,
each moved back by the term's offset, from the term that is rarest over all texts to the most common one.

Test items are taken in blocks of bounded size, each of which is sent to the tasks whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import written

#: Words of a segment, unless one text has more: then that text is a segment.
SEGMENT_WORDS = 1 << 20
#: Bytes of test items that one block may hold.
BLOCK_BYTES = 8 << 20

#: A-Z become a-z, digits, a-z and all bytes of non-ASCII characters stay, all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INDEX = "segment bigint, term string, at array<int>, id bigint"
_SPANS = "array<struct<item:bigint,start:int,stop:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _segment(number: int, ids: list, tokens: list[list[bytes]]):
    """Index rows of one segment: a row per term, and a row per text with its base and word count."""
    bases, total = [], 0
    for t in tokens:
        bases.append(total)
        total += len(t) + 1
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for t in tokens for w in t), np.int32, total - len(tokens))
    counts = np.array([len(t) for t in tokens], np.int64)
    position = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(tokens)), counts)
    order = np.argsort(flat, kind="stable")
    ends = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(np.bincount(flat, minlength=len(codes)), out=ends[1:])
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(position[order].astype(np.int32)))
    terms = pa.array(list(codes), pa.binary()).cast(pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), number)), terms, lists, pa.nulls(len(codes), pa.int64())],
                                     names=["segment", "term", "at", "id"])
    spans = pa.array([[b, int(n)] for b, n in zip(bases, counts, strict=True)], pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.nulls(len(ids), pa.string()), spans, pa.array(ids, pa.int64())],
                                     names=["segment", "term", "at", "id"])


def _indexed(limit: int):
    def step(batches):
        number = TaskContext.get().partitionId() << 32
        ids, tokens, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own = words(batch.column(1)[i].as_py())
                if ids and held + len(own) > limit:
                    yield from _segment(number, ids, tokens)
                    ids, tokens, held, number = [], [], 0, number + 1
                ids.append(batch.column(0)[i].as_py())
                tokens.append(own)
                held += len(own)
        if ids:
            yield from _segment(number, ids, tokens)

    return step


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the index of all texts.  Rows with a term hold its positions in the segment; rows without one
    stand for a text, ``at`` being its base and its number of words.  Null and empty texts have
    no words; repeated rows and ids are texts of their own; further columns are ignored."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(_indexed(segment_words), _INDEX))


def _windows(items: list[tuple[int, list[bytes]]], df: dict[bytes, int], size: int):
    """(item, window length, [(term, offset)] from the rarest term on) of all windows of all items."""
    out = []
    for item, tokens in items:
        for s in range(max(1, len(tokens) - size + 1)):
            window = tokens[s:s + size]
            order = sorted(range(len(window)), key=lambda o: (df.get(window[o], 0), o))
            if window and df.get(window[order[0]], 0):
                out.append((item, len(window), [(window[o].decode(), o) for o in order]))
    return out


def _among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted list: the longer side is searched by the shorter one."""
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _phrases(window, postings):
    """Positions at which all terms of a window stand in order."""
    _, _, terms = window
    first, offset = terms[0]
    found = postings[first] - offset
    for term, offset in terms[1:]:
        if not len(found):
            break
        found = found[_among(found + offset, postings[term])]
    return found


def _near(window, postings, bases, near):
    """(first, last) positions around the window's rarest term within which each other term occurs
    at most ``near`` words away, in the same text."""
    _, _, terms = window
    anchor = postings[terms[0][0]]
    text_of = np.searchsorted(bases, anchor, side="right")
    low, high = anchor.copy(), anchor.copy()
    keep = np.ones(len(anchor), bool)
    for term in {t for t, _ in terms[1:]} - {terms[0][0]}:
        at = postings[term]
        right = np.searchsorted(at, anchor)
        best, gap = np.zeros(len(anchor), np.int64), np.full(len(anchor), 1 << 40)
        for index in (right - 1, right):
            valid = (index >= 0) & (index < len(at))
            value = at[np.clip(index, 0, len(at) - 1)]
            away = np.where(valid & (np.searchsorted(bases, value, side="right") == text_of), np.abs(value - anchor), 1 << 40)
            best, gap = np.where(away < gap, value, best), np.minimum(gap, away)
        keep &= gap <= near
        low, high = np.where(keep, np.minimum(low, best), low), np.where(keep, np.maximum(high, best), high)
    return low[keep], high[keep] + 1


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _searched(windows, near):
    def step(rows: pa.Table) -> pa.Table:
        is_text = pc.is_null(rows["term"])
        texts, terms = rows.filter(is_text), rows.filter(pc.invert(is_text)).combine_chunks()
        where = np.array(texts["at"].to_pylist(), np.int64).reshape(-1, 2)
        order = np.argsort(where[:, 0], kind="stable")
        bases, counts, ids = where[order, 0], where[order, 1], texts["id"].take(pa.array(order))
        at = terms["at"].combine_chunks() if terms.num_rows else pa.array([], pa.list_(pa.int32()))
        ends, flat = at.offsets.to_numpy(), at.values.to_numpy().astype(np.int64)
        postings = {t: flat[ends[i]:ends[i + 1]] for i, t in enumerate(terms["term"].to_pylist())}
        found: dict[int, dict[int, list]] = {}
        for w in windows:
            if not all(t in postings for t, _ in w[2]):
                continue
            if near is None:
                starts = _phrases(w, postings)
                stops = starts + w[1]
            else:
                starts, stops = _near(w, postings, bases, near)
            for t, a, b in zip((np.searchsorted(bases, starts, side="right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
                found.setdefault(t, {}).setdefault(w[0], []).append((a, b))
        spans = []
        for t, base in enumerate(bases.tolist()):
            own = []
            for item, pairs in found.get(t, {}).items():
                own += [{"item": item, "start": a - base, "stop": b - base} for a, b in _merged(*np.array(pairs).T)]
            spans.append(own)
        kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))
        number = rows["segment"].to_pylist()[:1] * len(ids)
        return pa.table({"segment": pa.array(number, pa.int64()), "base": pa.array(bases), "id": ids, "n_words": pa.array(counts), "spans": pa.array(spans, kind)})

    return step


def matches(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13,
            near: int | None = None) -> DataFrame:
    """(id, n_words, spans) of every text of the index; spans are (item, start, stop) in words, merged per item.

    ``near`` None: occurrences of ``window`` consecutive item words (all words of a shorter item).  Otherwise:
    places where all words of a window stand in any order, at most ``near`` words from its rarest one.
    Items with a null id or without words match nothing; repeated items count once.
    """
    tests = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    parts = None
    for b in range(blocks):
        block = [(r.item, words(r.text)) for r in tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).distinct().collect()]
        vocabulary = Counter(w.decode() for _, tokens in block for w in tokens)
        terms = index.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
        held = index.where("term is not null").join(F.broadcast(terms), "term", "left_semi")
        df = {r.term.encode(): r.n for r in held.groupBy("term").agg(F.sum(F.size("at")).alias("n")).collect()}
        used = held.unionByName(index.where("term is null"))
        found = used.groupBy("segment").applyInArrow(_searched(_windows(block, df, window), near), f"segment bigint, base bigint, id bigint, n_words bigint, spans {_SPANS}")
        parts = found if parts is None else parts.unionByName(found)
    if blocks > 1:
        parts = parts.groupBy("segment", "base", "id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return parts.drop("segment", "base")


def covered_words(spans: str) -> Column:
    """Number of words inside any of the spans."""
    return F.expr(f"aggregate(sort_array(transform({spans}, s -> struct(s.start, s.stop))), struct(0 as upto, 0L as n),"
                  " (a, s) -> struct(greatest(a.upto, s.stop) as upto, a.n + greatest(0, s.stop - greatest(a.upto, s.start)) as n), a -> a.n)")


def contamination(index: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated): words inside occurrences of test windows and the items found;
    contaminated from one hit word in twenty on."""
    found = matches(index, items, window=window).withColumn("n_hit", covered_words("spans"))
    items_found = F.expr("array_sort(array_distinct(transform(spans, s -> cast(s.item as string))))")
    return found.select("id", "n_words", "n_hit", items_found.alias("items"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"), "spans")
