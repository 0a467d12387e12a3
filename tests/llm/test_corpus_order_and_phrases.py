"""Packing, spelling variants and collocations against brute force, and on odd rows."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codesieve.llm import collocations, packing, spelling

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- 11: packing ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(coder):
    own = packing.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(1)
    letters = ["a", "Z", " ", "  ", "\n", "\t", "é", "ß", "漢", "😀", "7", "42", ".", "'s", "'", " ", " ", "<|endoftext|>", "the ", " and", "\x00", "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["".join(map(chr, range(i, i + 64))) for i in range(0, 0xD800 - 64, 64)]
    assert all(own.ids(t).tolist() == e.ids for t, e in zip(texts, coder.encode_batch(texts, add_special_tokens=False), strict=True))


def test_long_texts_are_cut_without_effect(coder, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 20)
    own, rng = packing.Encoder(open(PATH, encoding="utf-8").read()), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " x", "é ", ".", "<|endoftext|>", "1"]) for _ in range(120))
        assert own.ids(text).tolist() == coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_and_moves_by_one(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dimensions))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check_pieces(pieces, want, length):
    """Every id of ``want`` (id -> lists of ids) is in one piece; sequences are without gaps and whole, the last ones powers of two."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert ids
        by_sequence[p.sequence_id].append((p.offset, len(ids)))
        by_doc[p.id].append((p.start, p.doc_tokens, ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for number in sorted(by_sequence):
        at = 0
        for offset, n in sorted(by_sequence[number]):
            assert offset == at
            at += n
        sizes.append(at)
    whole = [s for s in sizes if s == length]
    tail = sizes[len(whole):]
    assert sizes[:len(whole)] == whole and tail == sorted(set(tail), reverse=True) and all(s & (s - 1) == 0 and s < length for s in tail)
    for doc, texts in want.items():
        got = sorted(by_doc[doc])
        assert sorted(x for _, _, ids in got for x in ids) == sorted(x for t in texts for x in t)
        if len(texts) == 1:
            assert [x for _, _, ids in got for x in ids] == texts[0] and all(total == len(texts[0]) for _, total, _ in got)
            assert [s for s, _, _ in got] == np.cumsum([0, *[len(i) for _, _, i in got]])[:-1].tolist()
    assert set(by_doc) == set(want)


def test_packing(spark, coder, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("alpha", "river", "stone", "music")]
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(rng.randrange(5, 120))) for i in range(300)]
    texts += ["same words here"] * 200 + ["long " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    encoded = {i: [coder.encode(t, add_special_tokens=False).ids + [1]] for i, t in enumerate(texts)}
    for rows, length in ((1 << 16, 128), (100, 128)):
        monkeypatch.setattr(packing, "ROW_IDS", rows)
        pieces = packing.pack(docs, PATH, length=length).collect()
        check_pieces(pieces, encoded, length)
    near = defaultdict(list)
    for p in pieces:
        if p.id < 300 and p.start == 0:
            near[p.sequence_id].append(p.id % 4)
    pairs = [(a, b) for ids in near.values() for a, b in zip(ids, ids[1:], strict=False)]
    assert sum(a == b for a, b in pairs) > 0.6 * len(pairs)  # by chance a quarter
    odd = defaultdict(list)
    for r in odd_docs.collect():
        odd[r.doc_id].append(coder.encode(r.text or "", add_special_tokens=False).ids + [1])
    check_pieces(packing.pack(odd_docs, PATH).collect(), odd, 2048)
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_of_a_long_text_is_quick():
    own = packing.Encoder(open(PATH, encoding="utf-8").read())
    began = time.time()
    assert len(own.ids("x" * 1_000_000)) and len(own.ids(" " * 1_000_000)) and len(own.ids("ab " * 400_000))
    assert time.time() - began < 20


# --- 12: spelling variants ------------------------------------------------------------


def brute_counts(rows, least=7, occurrences=2, slips=31):
    counts = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= occurrences}


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, times=10):
    words = sorted(counts)
    near = {w: [v for v in words if edits_one(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_word_counts(spark, odd_docs, no_docs):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcéÀ÷Z") for _ in range(rng.randrange(6, 12))) for _ in range(40)]
    rows = [(i, ", ".join(rng.choice(stems) for _ in range(30))) for i in range(60)] + [(None, stems[0] + " " + stems[0]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == brute_counts(rows)
    assert spelling.word_counts(no_docs).count() == 0
    assert {r.word: r.n for r in spelling.word_counts(odd_docs, least=1, occurrences=1).collect()} == brute_counts([(r.doc_id, r.text) for r in odd_docs.collect()], 1, 1)


@pytest.mark.parametrize("tile, cut, block", [(8192, 50_000, 384), (8, 10**9, 3), (40, 10**9, 16)])
def test_variants(spark, monkeypatch, tile, cut, block):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "MOST_CUT", cut)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(n)) for n in (1, 2, 3, 4, 7, 8) for _ in range(60)} | {"x" * n for n in range(20, 30)} | {"中" + "x" * 20, "😀" * 7, "a\0b", "a\0", "\0\0"}
    counts = {w: rng.choice([1, 2, 5, 30, 400, 6000, 70_000]) for w in sorted(words)}
    frame = spark.createDataFrame([*counts.items(), (None, 5), ("", 9)], "word string, n long")
    got = [tuple(r) for r in spelling.variants(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(counts)


def test_variants_of_odd_tables(spark):
    long = "ab" * 60_000
    frame = spark.createDataFrame([(long, 3), (long[:-1], 40), (long + "x", 2), ("same", 1), ("same", 1)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    assert got == {"same": (None, "same", 2, 0, None), long: (long[:-1], long[:-1], 3, 2, 40), long[:-1]: (None, long[:-1], 40, 1, None), long + "x": (None, long + "x", 2, 1, None)}
    assert spelling.variants(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(frame, times=1)


# --- 13: collocations -----------------------------------------------------------------


def brute_collocations(rows, least, first, longest=4, contained=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in counts.items() if a >= least and len(key[1]) >= 2}
    out = set()
    for lang in totals:
        kept = []
        for (own, phrase), a in candidates.items():
            if own != lang:
                continue
            longer = [f for (x, q), f in candidates.items() if x == lang and len(q) > len(phrase) and any(q[i:i + len(phrase)] == phrase for i in range(len(q)))]
            if any(100 * f >= contained * a for f in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[lang, phrase[:c]] + counts[lang, phrase[c:]]), c, counts[lang, phrase[:c]], counts[lang, phrase[c:]])
                                        for c in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def some_texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "dé", "中文", "Ab", "new york city", "x\ty  z", "ou", "😀"]
    ends = [" ", " ", " ", "  ", ", ", ". ", "\t", "\n", "\r\n", " ; ", "!", "\x0b"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(letters) + rng.choice(ends) for _ in range(rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("trie_bytes, held, known, longest", [(6 << 20, 4_000_000, 10**6, 4), (300, 200, 5, 4), (150, 10, 10**6, 3), (6 << 20, 10**6, 10**6, 2)])
def test_collocations(spark, monkeypatch, trie_bytes, held, known, longest):
    for name, value in (("TRIE_BYTES", trie_bytes), ("HELD", held), ("KNOWN", known)):
        monkeypatch.setattr(collocations, name, value)
    rows = some_texts(120, 6)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, first in ((3, 2000), (6, 5)):
        got = [tuple(r) for r in collocations.collocations(docs, least=least, first=first, longest=longest).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_collocations(rows, least, first, longest)


def test_collocations_of_odd_tables(spark, odd_docs, no_docs):
    got = {tuple(r) for r in collocations.collocations(odd_docs, least=2).collect()}
    assert got == brute_collocations([(r.lang, r.text) for r in odd_docs.collect()], 2, 2000)
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(odd_docs.where("text is null or text = ''")).count() == 0
    long = spark.createDataFrame([("en", "word" * 50_000 + " end")] * 3 + [("en", "")], "lang string, text string")
    assert [(r.a, r.l, r.r, r.n) for r in collocations.collocations(long, least=3).collect()] == [(3, 3, 3, 6)]


@pytest.mark.parametrize("fans", [[300 - 44], [1] * 500, [2, 3, 7, 40, 200, 1, 1, 255, 256], list(range(1, 60))])
def test_double_array(fans):
    rng = random.Random(7)
    phrases = sorted({"".join(chr(rng.randrange(33, 33 + min(f, 90))) for _ in range(rng.randrange(1, 9))) for f in fans for _ in range(f)})
    langs = [rng.choice("ab") for _ in phrases]
    trie = collocations.Trie(langs, pa.array(phrases))
    for i, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
        state = trie.roots[lang]
        for c in phrase.encode():
            after = trie.base[state] + c
            assert trie.check[after] == state
            state = after
        assert trie.accept[state] == i
    assert (trie.accept >= 0).sum() == len(phrases)


def test_scores_are_exact_beyond_64_bits(spark):
    a, b = 2**62 + 1, 2**62 + 2
    frame = spark.createDataFrame([(a, b, b)], "a long, l long, r long")
    wide = "cast({} as decimal(20,0))".format
    assert frame.selectExpr(f"{wide('a')} * 2000000 div ({wide('l')} + {wide('r')}) s").first().s == 2_000_000 * a // (2 * b)
