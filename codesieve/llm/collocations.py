"""Collocations by double-array tries of Apriori-safe candidates.

Two passes over the texts.  The first counts the hashed phrases of each length in a sketch: a phrase whose bucket has
fewer occurrences than asked for cannot have them itself.  The second lists the phrases that are Apriori-safe by the
sketch, that is with all their parts: at each place the longest one, a window whose beginnings are candidates too, each once in a while of a task with its number of places.
Windows that begin alike meet in one task, however many candidates there are, and no text is read again for them.  There the candidates, in shards of a bounded number
of bytes, become byte-level tries in double-array form; numpy advances the states of all windows of a shard
together, a byte a level, and bincounts the accepting states at word ends, each window as often as it occurs.
Scores, containment and ranks are joins and aggregates of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import ascii_lower, mix, text_bytes, text_steps, word_bounds, word_hashes, written

#: Sketch: buckets of a stored slice; least and most bits of the bucket number (2^26 bits are 8 MB for each length).
SLICE, LEAST_BITS, MOST_BITS = 1 << 16, 18, 26
#: Counts that a sketching task holds before it sends them on; windows that a listing task holds.
HELD, KNOWN = 4_000_000, 1_000_000
#: Text bytes of a step, bytes of the windows of a trie, which bound its nodes, and text bytes for each partition of windows.
STEP, TRIE_BYTES, DEALT = 1 << 21, 6 << 20, 32 << 20
#: Parts into which joins and ranks of one key are dealt.
SALTS = 8

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_INSIDE = np.ones(256, bool)
_INSIDE[list(_ENDS + b" \t")] = False
_PIECE_END = np.zeros(256, bool)
_PIECE_END[list(_ENDS)] = True
_GAP, _STOP = 0x20, 0x0A
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch (lang, text): byte ranges, rows, and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        self.data = ascii_lower(data)
        self.starts, self.ends, first = word_bounds(self.data, offsets, _INSIDE)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        piece = np.cumsum(_PIECE_END[self.data])[self.starts] if len(data) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.starts), bool)
        self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])

    def phrase_hashes(self, langs: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the places (first words) of phrases and their hashes, of language and words."""
        word = word_hashes(self.data, self.starts, self.ends)
        at = np.arange(len(word))
        h = mix(langs[self.row] * _FACTOR + word)
        out = [(at, h)]
        for k in range(1, longest):
            go = self.joined[at + k - 1]
            at, h = at[go], h[go]
            h = mix(h * _FACTOR + word[at + k])
            out.append((at, h))
        return out

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' bytes, each word followed by a blank, or by a line feed at a piece's end; and the words' starts in it."""
        lengths = self.ends - self.starts
        begins = np.cumsum(lengths + 1) - lengths - 1
        out = np.empty(int(lengths.sum()) + len(lengths), np.uint8)
        number = np.repeat(np.arange(len(lengths)), lengths)
        inner = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[begins[number] + inner] = self.data[self.starts[number] + inner]
        out[begins + lengths] = np.where(self.joined, _GAP, _STOP)
        return out, begins


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = text_bytes(batch.column(0))
    return word_hashes(data, offsets[:-1], offsets[1:]) if len(data) else np.zeros(batch.num_rows, np.uint64)


def _sketched(bits: int, longest: int, least: int):
    """Counts of hashed phrases, as rows of a slice's buckets; rows of length 0 hold the words of a language."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(longest)]
        totals: dict[str, int] = {}

        def sent(last: bool):
            rows: list[tuple] = []
            for k, parts in enumerate(held):
                if not parts:
                    continue
                buckets, counts = (np.concatenate(z) for z in zip(*parts, strict=True))
                buckets, at = np.unique(buckets, return_inverse=True)
                counts = np.minimum(np.bincount(at, counts), least).astype(np.uint8 if least < 256 else np.uint32)
                part = buckets // SLICE
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                inner = (buckets % SLICE).astype(np.uint16)
                rows += [(k + 1, int(part[a]), None, None, inner[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                parts.clear()
            if last:
                rows += [(0, 0, lang, n, None, None) for lang, n in totals.items()]
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k", "slice", "lang", "n", "places", "counts"])

        size = 0
        for batch in batches:
            for part in text_steps(batch, limit=STEP):
                words = Words(part)
                for lang, n in zip(part.column(0).to_pylist(), np.bincount(words.row, minlength=part.num_rows).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                for k, (_, h) in enumerate(words.phrase_hashes(_langs(part), longest)):
                    if len(h):
                        found = np.unique((h >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                        held[k].append(found)
                        size += len(found[0])
                if size > HELD:
                    yield sent(False)
                    size = 0
        yield sent(True)

    return step


def _merged(least: int):
    """Bits of the buckets that have ``least`` occurrences, and the words of each language (length 0); rows come sorted by length and slice."""
    kind = np.uint8 if least < 256 else np.uint32

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(SLICE, np.int64)

        def sent(k, number, lang, n, bits):
            columns = [pa.array([v], t) for v, t in ((k, pa.int32()), (number, pa.int32()), (lang, pa.string()), (n, pa.int64()), (bits, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["k", "slice", "lang", "n", "bits"])

        def bits():
            return np.packbits(sums >= least, bitorder="little").tobytes()

        words: dict[str, int] = {}
        for batch in batches:
            for k, number, lang, n, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == 0:
                    words[lang] = words.get(lang, 0) + n
                    continue
                if (k, number) != key:
                    if key is not None:
                        yield sent(*key, None, None, bits())
                    key = (k, number)
                    sums[:] = 0
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, kind)  # a row names each bucket once
        if key is not None:
            yield sent(*key, None, None, bits())
        for lang, n in words.items():
            yield sent(0, 0, lang, n, None)

    return step


def _taken(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    return data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


class _Windows:
    """Windows by their hash: key, language, text, number of places, and whether one of them has a pair."""

    def __init__(self):
        self.codes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in the order of the codes; the other columns are in that of their arrival
        self.n, self.part = np.zeros(0, np.int64), np.zeros(0, bool)
        self.new: list[tuple] = []

    def add(self, codes: np.ndarray, part: np.ndarray, key: np.ndarray, lang: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        codes, first, at, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        part = np.bincount(at[part], minlength=len(codes)) > 0
        place = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        known[place < len(self.codes)] = self.codes[place[place < len(self.codes)]] == codes[place < len(self.codes)]
        old = self.number[place[known]]
        self.n[old] += n[known]
        self.part[old] |= part[known]
        first = first[~known]
        self.number = np.insert(self.number, place[~known], len(self.n) + np.arange(len(first)))
        self.codes = np.insert(self.codes, place[~known], codes[~known])
        self.n, self.part = np.concatenate([self.n, n[~known]]), np.concatenate([self.part, part[~known]])
        self.new.append((key[first], lang[first], lengths[first], _taken(data, starts[first], lengths[first])))

    def sent(self, langs: list[str], parts: int) -> Iterator[pa.RecordBatch]:
        """A row for each partition and language: the columns' bytes one after the other, compressed; windows that begin alike are neighbours."""
        if not len(self.n):
            return
        key, lang, lengths, data = (np.concatenate(z) for z in zip(*self.new, strict=True))
        starts, n, part = np.cumsum(lengths) - lengths, self.n, self.part
        self.__init__()
        order = np.lexsort((key, lang, key % parts))
        key, lang, lengths, starts, n, part = (x[order] for x in (key, lang, lengths, starts, n, part))
        to = key % parts
        edges = np.flatnonzero(np.diff(to, prepend=-1) | np.diff(lang, prepend=-1)).tolist()
        rows: list[tuple] = []
        for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
            body = b"".join([key[a:b].tobytes(), lengths[a:b].astype(np.uint32).tobytes(), n[a:b].astype(np.uint32).tobytes(), part[a:b].tobytes(), _taken(data, starts[a:b], lengths[a:b]).tobytes()])
            rows.append((int(to[a]), langs[lang[a]], b - a, len(body), pa.compress(body, codec="zstd", asbytes=True)))
            if len(rows) == 1024 or b == len(key):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["to", "lang", "n", "size", "body"])
                rows = []


def _opened(n: int, size: int, body: bytes) -> pa.Table:
    """(phrase, key, n, part) of a row of windows."""
    body = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True)
    key, lengths, times = (np.frombuffer(body, kind, n, 4 * n * i) for i, kind in enumerate((np.int32, np.uint32, np.uint32)))
    part, data = np.frombuffer(body, bool, n, 12 * n), np.frombuffer(body, np.uint8, offset=13 * n)
    return pa.table({"phrase": _strings(data, lengths), "key": key, "n": times.astype(np.int64), "part": part})


def _listed(sketch, bits: int, longest: int, parts: int):
    """At each place the longest phrase all of whose parts pass the sketch, and its first word alone, each once in a while of a task,
    with a key, of its first two words, that deals them to the partitions, the number of places and, for a word alone, whether it lies in a longer candidate."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(t, np.uint8) for t in sketch.value]
        held, names = (_Windows(), _Windows()), {}
        for batch in batches:
            for part in text_steps(batch, limit=STEP):
                words = Words(part)
                n = len(words.starts)
                passed, top, code, key, pair = np.ones(n + 1, bool), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n + 1, bool)
                alone = None
                for k, (at, h) in enumerate(words.phrase_hashes(_langs(part), longest)):
                    bucket = h >> np.uint64(64 - bits)
                    bit = tables[k][(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1
                    ok = (bit == 1) & passed[at] & passed[at + (k > 0)]
                    at, h = at[ok], h[ok]
                    passed = np.zeros(n + 1, bool)
                    passed[at] = True
                    top[at], code[at] = k + 1, h
                    if k == 0:
                        alone = at, h
                    if k == 1:
                        key[at], pair[at], pair[at + 1] = h, True, True
                    if longest == 1:
                        pair[at] = True
                stream, begins = words.stream()
                row_lang = np.array([names.setdefault(lang, len(names)) for lang in part.column(0).to_pylist()], np.int64)
                lang, lengths = row_lang[words.row], words.ends - words.starts
                at, h = alone
                held[0].add(h, pair[at], (h >> np.uint64(33)).astype(np.int32), lang[at], stream, begins[at], lengths[at])
                at = np.flatnonzero(top > 1)
                last = at + top[at] - 1
                held[1].add(code[at], pair[at], (key[at] >> np.uint64(33)).astype(np.int32), lang[at], stream, begins[at], begins[last] + lengths[last] - begins[at])
                if len(held[0].n) + len(held[1].n) > KNOWN:
                    for own in held:
                        yield from own.sent(list(names), parts)
        for own in held:
            yield from own.sent(list(names), parts)

    return step


class Trie:
    """Byte-level tries of phrases, a root for each language, in one double array.

    The state after byte ``c`` in state ``s`` is ``t = base[s] + c`` if ``check[t] == s``; ``accept[t]`` is the number of the
    phrase that ends there, or -1.
    """

    def __init__(self, langs: list[str], phrases: pa.Array):
        data, offsets = text_bytes(phrases)
        lengths = np.diff(offsets)
        names = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(names)}
        node = np.array([number[x] for x in langs], np.int64)
        parents, symbols, children, made = [], [], [], len(names)
        active = np.arange(len(lengths))
        for level in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > level]
            edges, at = np.unique(node[active] << 8 | data[offsets[active] + level], return_inverse=True)
            parents.append(edges >> 8)
            symbols.append(edges & 255)
            children.append(np.arange(made, made + len(edges)))
            node[active] = made + at
            made += len(edges)
        parent, symbol, child = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (parents, symbols, children))
        slot, base = _placed(parent, symbol, child, made, len(names))
        size = int(max(slot.max(initial=0), base.max(initial=0))) + 257
        self.roots = {lang: int(slot[i]) for lang, i in number.items()}
        self.base, self.check, self.accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[child]] = slot[parent]
        self.accept[slot[node]] = np.arange(len(node))

    def count(self, langs: list[str], stream: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The occurrences of all phrases at the beginnings of windows: words in a stream, each followed by a blank, or by a line feed at a window's end."""
        state = np.array([self.roots.get(lang, -1) for lang in langs], np.int32)
        known = state >= 0
        at, state, times = at[known], state[known], times[known]
        whole, often = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while len(at):
            symbol = stream[at]
            ends = (symbol == _GAP) | (symbol == _STOP)
            found = self.accept[state[ends]]
            whole.append(found[found >= 0])
            often.append(times[ends][found >= 0])
            after = self.base[state] + symbol
            go = self.check[after] == state
            at, state, times = at[go] + 1, after[go], times[go]
        return np.bincount(np.concatenate(whole), np.concatenate(often), len(self.accept)).astype(np.int64)


def _placed(parent: np.ndarray, symbol: np.ndarray, child: np.ndarray, nodes: int, roots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and bases of all nodes so that no two children share a slot.

    Nodes with more children go first.  In each round all unplaced nodes try one random base together; a node keeps
    it if its slots are free and no other node has tried them first.  Only children fill what is free.
    """
    slot, base = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
    order = np.argsort(parent, kind="stable")
    parent, symbol, child = parent[order], symbol[order], child[order]
    fan = np.bincount(parent, minlength=nodes)
    size = 512 + roots + 2 * len(parent)
    used = np.zeros(size + 512, bool)
    slot[:roots] = 256 + np.arange(roots)
    used[:256 + roots] = True
    random = np.random.default_rng(13)
    for least, most in ((33, 256), (9, 32), (4, 8), (2, 3)):
        open_ = (fan[parent] >= least) & (fan[parent] <= most)
        p, s, c = parent[open_], symbol[open_], child[open_]
        while len(p):
            edges = np.flatnonzero(np.diff(p, prepend=-1))
            group = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
            tried = random.integers(1, size, len(edges))
            target = tried[group] + s
            free = ~used[target]
            _, first = np.unique(target, return_index=True)
            mine = np.zeros(len(p), bool)
            mine[first] = True
            lost = np.bincount(group, ~(free & mine), len(edges)) > 0
            kept = ~lost[group]
            used[target[kept]] = True
            slot[c[kept]] = target[kept]
            base[p[edges][~lost]] = tried[~lost]
            if lost.all():  # too dense for the fan: more room
                used = np.concatenate([used, np.zeros(size, bool)])
                size *= 2
            p, s, c = p[~kept], s[~kept], c[~kept]
    single = fan[parent] == 1
    room = np.flatnonzero(~used)
    if len(room) < single.sum():
        room = np.concatenate([room, np.arange(len(used), len(used) + int(single.sum()))])
    target = room[:int(single.sum())]
    slot[child[single]] = target
    base[parent[single]] = target - symbol[single]
    return slot, base


def _counted(lang: str, rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Exact counts (lang, k, phrase, f) of the candidates of a shard: beginnings of two and more words, and words alone that lie in longer ones."""
    blank = pc.match_substring(rows["phrase"], " ")
    for rows in (rows.filter(pc.and_(pc.invert(blank), rows["part"])), rows.filter(blank)):  # in one trie the words alone would count the windows that begin so
        if not len(rows):
            continue
        data, offsets = text_bytes(rows["phrase"].combine_chunks())
        lengths = np.diff(offsets)
        begins = offsets[:-1] + np.arange(len(lengths))
        stream = np.full(len(data) + len(lengths), _STOP, np.uint8)
        stream[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
        ends = np.flatnonzero((stream == _GAP) | (stream == _STOP))
        row = np.searchsorted(begins, ends, "right") - 1
        k = np.arange(len(ends)) - np.searchsorted(row, row) + 1
        keep = (k > 1) | (k == np.bincount(row)[row])
        row, k, ends = row[keep], k[keep], ends[keep]
        phrases = _strings(_taken(stream, begins[row], ends - begins[row]), ends - begins[row])
        sums = Trie([lang] * len(phrases), phrases).count([lang] * len(rows), stream, begins, rows["n"].to_numpy())
        some = np.flatnonzero(sums >= max(least, 1))
        columns = [pa.array([lang] * len(some), pa.string()), pa.array(k[some].astype(np.int32)), phrases.take(pa.array(some)).cast(pa.string()), pa.array(sums[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])


def _merged_windows(held: list[pa.Table]) -> pa.Table:
    """Each window once, told apart by its bytes, in the order of the keys."""
    rows = pa.concat_tables(held).combine_chunks().group_by(["phrase", "key"], use_threads=False).aggregate([("n", "sum"), ("part", "any")])
    return rows.rename_columns({"n_sum": "n", "part_any": "part"}).select(["phrase", "key", "n", "part"]).sort_by("key")


def _tried(least: int):
    """Counts of the candidates of a partition's windows; those of a key are in one trie."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, n, length, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(lang, []).append(_opened(n, length, body))
                size[lang] = size.get(lang, 0) + n
                if size[lang] > max(KNOWN, 2 * len(held[lang][0])):  # the first holds what is merged
                    held[lang] = [_merged_windows(held[lang])]
                    size[lang] = len(held[lang][0])
        for lang in list(held):
            rows = _merged_windows(held.pop(lang))
            key, ends = rows["key"].to_numpy(), np.cumsum(pc.binary_length(rows["phrase"]).to_numpy())
            lo = 0
            while lo < len(key):
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TRIE_BYTES, "right"))
                hi = max(int(np.searchsorted(key, key[hi])) if hi < len(key) else hi, int(np.searchsorted(key, key[lo], "right")))  # whole keys, one at least
                yield from _counted(lang, rows.slice(lo, hi - lo), least)
                lo = hi

    return step


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of phrases with at least ``least`` occurrences, (lang, n) of all words).

    All phrases of 2 to ``longest`` words are there, and of the single words those that occur in a longer one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 4).bit_length()))
    sketch = rows.mapInArrow(_sketched(bits, longest, least), "k int, slice int, lang string, n bigint, places binary, counts binary")
    dealt = sketch.repartition("k", "slice").sortWithinPartitions("k", "slice")
    merged = written(dealt.mapInArrow(_merged(least), "k int, slice int, lang string, n bigint, bits binary"))
    totals = merged.where("k = 0 and n > 0").select("lang", "n")
    tables = [bytearray(1 << bits >> 3) for _ in range(longest)]
    for row in merged.where("k > 0").select("k", "slice", "bits").toLocalIterator():  # at most 2^MOST_BITS bits for each length
        tables[row.k - 1][row.slice * SLICE // 8:(row.slice + 1) * SLICE // 8] = row.bits
    sent = spark.sparkContext.broadcast([bytes(t) for t in tables])
    parts = max(1, -(-size // DEALT))
    listed = rows.mapInArrow(_listed(sent, bits, longest, parts), "to int, lang string, n int, size bigint, body binary")
    met = listed.repartitionById(parts, "to").select("lang", "n", "size", "body")
    return written(met.mapInArrow(_tried(least), "lang string, k int, phrase string, f bigint")), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, contained: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score, then count, then phrase.

    Texts, A-Z in lower case, are cut at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words.  ``a`` is the
    phrase's count, ``l`` and ``r`` those of its parts at the cut with the least score, of equal ones the first;
    the score is floor(2000000 * a / (l + r)), ``n`` the words of the language.  A phrase inside a longer candidate with at
    least ``contained`` percent of its count is left out.  A null language is ``und``; null and empty
    texts have no words; repeated rows count again; texts may be of any length.  Words are told apart byte by byte; only the
    listing of windows in a task holds phrases of one 64-bit hash as the same.
    """
    counts, totals = phrase_counts(docs, least, longest, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates = counts.where("k >= 2").select("lang", "phrase", "k", words.alias("words"), F.col("f").alias("a"))
    cut = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cut = cut.withColumn("left", F.expr("array_join(slice(words, 1, cut), ' ')")).withColumn("right", F.expr("array_join(slice(words, cut + 1, k - cut), ' ')"))
    # A word may begin or end a large share of all phrases: each part's count goes to all salts.
    part = counts.where(F.col("k") < longest).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = cut.join(part.select("lang", "salt", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "salt", "left"])
    cut = cut.join(part.select("lang", "salt", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "salt", "right"])
    wide = "cast({} as decimal(20,0))".format
    cut = cut.withColumn("score", F.expr(f"{wide('a')} * 2000000 div ({wide('l')} + {wide('r')})"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = F.expr("array_distinct(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' ')))))")
    longer = candidates.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or {wide('longer')} * 100 < {wide('a')} * {contained}"))
    flat = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
