"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The pre-tokeniser's pattern cuts a text into words, which merges never cross.  Inside a word, tokens are
emitted as soon as no later byte can change them.  How far that reaches is computed from the merge list:
a merge (a, b) of rank r fails only if a piece on the right edge of b is taken first by a merge with its right
neighbour, of a rank below the one at which the piece joins its own left neighbour; that neighbour must itself
hold until then, and so on with ever smaller ranks, so the chains are finite.  The longest one in bytes is the
sufficient lookahead: a window of more bytes has its tokens before the last ``lookahead`` bytes right.

Decoding runs the tokens' bytes through an incremental UTF-8 decoder, which keeps at most three bytes.
Memory beyond the text and the model is constant: one piece of text, one window, a cache of a set size.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import text_steps

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a piece; pieces end before white space that follows something else, where words end.
PIECE = 1 << 15
#: Words and their tokens that are kept, and the longest word kept.
CACHE, CACHED_LENGTH = 200_000, 32
_CUT = regex.compile(r"(?<=\S)\s")
#: A blank beside other white space, or white space at an end: then blanks alone do not tell where words end.
_UNEVEN = re.compile(r" \s|\s |^\s|\s$")
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level models")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [vocab[next(c for c, v in letters.items() if v == b)] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.new = {rank: new for rank, new in self.merges.values()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Longest chain of right neighbours, in bytes, that can decide over a merge."""
        made = {}
        for (a, b), (rank, new) in self.merges.items():
            made.setdefault(new, (rank, b))
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}  # of a left piece: greatest reach of its merges so far, by rank
        longest = 0
        for (a, b), (rank, _) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            beyond, piece, until = 0, b, rank
            while True:  # pieces on the right edge of b, each until it joins its left neighbour
                at = bisect_left(ranks.get(piece, []), until)
                if at:
                    beyond = max(beyond, reach[piece][at - 1])
                if piece not in made:
                    break
                until, piece = made[piece]
            own = len(self.bytes[b]) + beyond
            longest = max(longest, own)
            ranks.setdefault(a, []).append(rank)
            reach.setdefault(a, []).append(max(own, reach[a][-1] if reach.get(a) else 0))
        return longest

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a byte string by its merges: lowest rank first, then leftmost."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._merged_long(ids)
        rank_of, new_of = self.ranks.get, self.new
        ranks = [rank_of(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i] = new_of[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked neighbours."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (m := merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [x for x in ids if x >= 0]

    def transduced(self, data: bytes, window: int | None = None):
        """Tokens of one word, emitted in order once stable; holds one window of bytes at a time."""
        window = window or 4 * self.lookahead + 256
        if window <= self.lookahead + max(map(len, self.bytes.values())):
            raise ValueError("the window must exceed the lookahead and the longest token")
        done = 0
        while done < len(data):
            part = data[done:done + window]
            last = done + window >= len(data)
            for token in self.merged(part):
                size = len(self.bytes[token])
                if not last and len(part) - size < self.lookahead:
                    break
                part = part[size:]
                done += size
                yield token


def pieces(text: str, size: int = PIECE):
    """The text in parts that end where a word ends; a longer stretch without such a place stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Cache:
    """The entries of the last and the current generation; a generation ends when it is full."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def put(self, key, value):
        if len(self.now) >= self.size:
            self.before, self.now = self.now, {}
        self.now[key] = value
        return value


class Coder:
    """Encodes and decodes texts with one model; the caches have a set size."""

    def __init__(self, model: Model):
        self.model, self.cache, self.chunks = model, Cache(CACHE), Cache(CACHE)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in model.special) + ")") if model.special else None

    def encoded(self, text: str):
        """Lists of token ids, one for each piece of the text; special tokens count wherever they stand."""
        if self.split is not None and any(s in text for s in self.model.special):
            for part in self.split.split(text):
                if part in self.model.special:
                    yield [self.model.special[part]]
                elif part:
                    yield from self._plain(part)
        elif text:
            yield from self._plain(text)

    def _words(self, text: str):
        """Tokens of a text, word by word."""
        now, before = self.cache.now.get, self.cache.before.get
        for match in self.words.finditer(text):
            word = match.group()
            if len(word) > CACHED_LENGTH:
                yield from self.model.transduced(word.encode())
            else:
                known = now(word) or before(word)
                if known is None:
                    known = self.cache.put(word, tuple(self.model.merged(word.encode())))
                    now, before = self.cache.now.get, self.cache.before.get
                yield from known

    def _plain(self, text: str):
        for piece in pieces(text):
            if _UNEVEN.search(piece) or len(piece) > 2 * PIECE:
                ids = []
                for token in self._words(piece):
                    ids.append(token)
                    if len(ids) >= PIECE:
                        yield ids
                        ids = []
                yield ids
                continue
            # Every blank stands between other characters, so a word ends before it: whole chunks are looked up.
            first, *rest = piece.split(" ")
            ids = list(self._words(first))
            now, before = self.chunks.now.get, self.chunks.before.get
            for chunk in rest:
                known = now(chunk)
                if known is None:
                    known = before(chunk) or tuple(self._words(" " + chunk))
                    if len(chunk) <= CACHED_LENGTH:
                        self.chunks.put(chunk, known)
                        now, before = self.chunks.now.get, self.chunks.before.get
                ids += known
            yield ids

    def decoded(self, lists):
        """Text of lists of ids, part by part."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.model.bytes
        for ids in lists:
            yield state.decode(b"".join([table[i] for i in ids]))
        yield state.decode(b"", True)


def _digests(coder: Coder, names: dict[int, str], text: str | None) -> tuple[int, str, str]:
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

    def counted():
        nonlocal n
        for ids in coder.encoded(text or ""):
            if ids:
                ids_hash.update(((b"," if n else b"") + ",".join([names[i] for i in ids]).encode()))
                n += len(ids)
                yield ids

    for part in coder.decoded(counted()):
        text_hash.update(part.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _coded(content, ids: bool):
    def step(batches):
        coder = Coder(Model(content.value))
        names = {i: str(i) for i in coder.model.bytes}
        for batch in batches:
            for part in text_steps(batch):
                texts = part.column(1).to_pylist()
                if ids:
                    lists = [[i for x in coder.encoded(t or "") for i in x] for t in texts]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["id", "ids"])
                else:
                    rows = [_digests(coder, names, t) for t in texts]
                    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return step


def _prepared(docs: DataFrame, path: str, id_col: str, text_col: str):
    with open(path, encoding="utf-8") as file:  # a vocabulary has a fixed size: the driver sends it to the tasks
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")), content


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the tokens of the whole text; none for a null or empty one.  ``path`` is a
    byte-level model file that the driver can read.  Ids may be null or repeat."""
    texts, content = _prepared(docs, path, id_col, text_col)
    return texts.mapInArrow(_coded(content, True), "id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows (id, ids); null ids give an empty text, unknown numbers raise."""
    with open(path, encoding="utf-8") as file:
        content = tokens.sparkSession.sparkContext.broadcast(file.read())

    def step(batches):
        coder = Coder(Model(content.value))
        for batch in batches:
            texts = ["".join(coder.decoded([ids or []])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.selectExpr("cast(id as bigint) id", "ids").mapInArrow(step, "id bigint, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again, piece by piece."""
    texts, content = _prepared(docs, path, id_col, text_col)
    return texts.mapInArrow(_coded(content, False), "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
