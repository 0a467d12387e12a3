"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codesieve.llm import bpe, jaccard, langid, nearvec, personal, postings, quality, render, secrets, shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- 1: decontamination ---------------------------------------------------------------


def test_phrases_and_proximity(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d"), (2, "x " * 14), (3, None), (None, "a b"), (4, "b a"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z A b c d z z"), (2, "x " * 15), (3, "a b c"), (4, "d b a c"), (5, None), (6, "c d")], "doc_id long, text string")
    index = postings.build_index(docs, segment_words=10)
    got = {r.id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in postings.contamination(index, items).collect()}
    assert got == {1: (7, 4, ["1"], True), 2: (15, 15, ["2"], True), 3: (3, 0, [], False), 4: (4, 2, ["4"], True), 5: (0, 0, [], False), 6: (2, 0, [], False)}
    near = {r.id: {s["item"] for s in r.spans} for r in postings.matches(index, items, near=3).collect()}
    assert near[4] == {1, 4} and near[1] == {1, 4} and near[6] == set()
    odd = postings.contamination(postings.build_index(odd_docs), items).collect()
    assert len(odd) == 11 and max(r.n_words for r in odd) == 10
    assert postings.contamination(postings.build_index(no_docs), items).count() == 0
    assert {r.n_hit for r in postings.contamination(index, items.where("false")).collect()} == {0}


# --- 2: HTML --------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<ul><li>a<li>b<ul><li>c</ul></ul>t", "- a\n- b\n  - c\n\nt"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Age<tr><td>Al<td>30</table>", "Name  Age\nAl    30"), ("<p>a  b\n c<p hidden>no<p style='display: none'>no<p>d", "a b c\n\nd"),
    ("<title>t</title><script>x</script>a &amp; b<!-- c -->d", "a & bd"), ("<pre> x\n  y</pre>", " x\n  y"), ("<div>" * 5000 + "deep", "deep"), ("<b>x</p></i>y", "x\n\ny".replace("\n\n", "")),
])
def test_rendering(page, text):
    assert render.render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p>let <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation encoding=t>no</annotation></semantics></math> be", "let x= 1 2 be"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><defs/><circle r=1 /><text>Up</text><text>Down <tspan>now</tspan></text></svg>b", "a Up Down now b"),
    ("a<svg><path d='m0 0'/><g><path/></g></svg><svg/>b<desc>c</desc>", "a bc"), ("<svg style='display:none'><text>no</text></svg><svg display=none><text>no</text></svg>a", "a"),
    ("<form><input type=submit value='Go on'><input type=Button value=Stop><input type=hidden value=no></form>", "Go on Stop"),
    ("<object><p>instead</object><object data=x>no</object>", "instead"), ("<table><tr><td><math><mn>1</mn></math><td><svg><text>b</text></svg></table>", "1  b"),
])
def test_rendering_of_drawings_formulas_and_buttons(page, text):
    assert render.render(page) == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, text string, html string")
    assert sorted((r.id or 0, r.text) for r in render.extract(pages).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert render.extract(pages.where("false")).count() == 0


# --- 3: Jaccard join ------------------------------------------------------------------


def test_jaccard_join(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = []
    for size in (4, 6, 9, 14, 25, 40, 80):
        for _ in range(6):
            base = [f"w{rng.randrange(400)}" for _ in range(size + 4)]
            for changes in range(5):
                own = list(base)
                for _ in range(min(changes, size // 25)):
                    own[rng.randrange(len(own))] = f"v{rng.randrange(1000)}"
                texts.append(" ".join(own[: len(own) - rng.randrange(3)]))
    shared = " ".join(f"s{i}" for i in range(30))
    texts += [shared + f" t{i} u{i} v{i}" + f" y{i % 3}" for i in range(60)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component) for r in jaccard.similar_components(docs).collect()}
    want = roots(range(len(texts)), links)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    odd = Counter((r.id, r.n_shingles, r.component) for r in jaccard.similar_components(odd_docs).collect())
    assert odd == Counter({(1, 6, 1): 1, (2, 6, 1): 2, (3, 0, 3): 1, (4, 0, 4): 1, (None, 6, None): 1, (5, 0, 5): 1, (6, 1, 6): 1, (7, 1, 7): 1, (8, 1, 8): 1, (9, 1, 9): 1})
    assert jaccard.similar_components(no_docs).count() == 0


def test_jaccard_join_with_an_id_on_different_texts(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(5, a), (5, b), (5, c), (7, [*a, "tail"]), (8, [*b, "tail"]), (9, ["head", *c]), (1, [*c, "tail"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.id, r.n_shingles, r.component) for r in jaccard.similar_components(docs).collect())
    assert got == sorted([(5, 36, 5), (5, 36, 5), (5, 36, 1), (7, 37, 5), (8, 37, 5), (9, 37, 1), (1, 37, 1)])


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 60, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 4:], rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(a)) == 0


# --- 4: personal data -----------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if not ((kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "phone" and not 9 <= len(digits) <= 15)
                    or (kind == "card" and not (13 <= len(digits) <= 19 and personal.luhn(digits)))):
                yield (kind, *m.span())


def test_base_spans():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b@", "c.d", "1", "23", ".", "+", " ", "-", "(", "4111111111111111", "é", "%", "@e.f"]) for _ in range(rng.randrange(25)))
        assert personal.base_spans(t) == list(plain_spans(t)), t


def test_personal_data(spark, odd_docs, no_docs):
    learn = [f"mail u{i}@host{i % 7}.org or +49 30 1234{i:03d} from 10.0.{i % 200}.7, card 4111 1111 1111 1111" for i in range(60)]
    own = personal.train(learn)
    base, added = personal.find(own, "write to jane (at) host5.org or 0049 30 1234777, born 2024-01-01 12:00")
    assert base == [] and ("email", 9, 28) in added and all(k != "ip" for k, _, _ in added)
    text = "u1@host.org jane (at) host5.org"
    base, added = personal.find(own, text)
    assert base == [("email", 0, 11)] and all(a >= 11 for _, a, _ in added)
    assert {(len(r.base), len(r.added)) for r in personal.spans(odd_docs, own).collect()} == {(0, 0)}
    assert personal.spans(no_docs, personal.fit(no_docs)).count() == 0


# --- 5: vectors -----------------------------------------------------------------------


@pytest.mark.parametrize("cell, block", [(8192, 4096), (40, 16)])
def test_near_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(nearvec, "CELL", cell)
    monkeypatch.setattr(nearvec, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    x[5] = x[6]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    want = roots(range(200), zip(*map(list, np.nonzero(close)), strict=True))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 4, 0), (1002, [1.0, float("nan"), 0.0, 0.0], 0), (1003, [1.0, None, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (1004, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = {r.id: r for r in nearvec.near_vectors(frame).collect()}
    assert len(got) == 206
    assert all((got[i].n_links, got[i].component, got[i].kept) == (int(close[i].sum()), want[i], want[i] == i) for i in range(200))
    assert all((got[i].n_links, got[i].component) == (0, i) for i in (1000, 1001, 1002, 1003, 1004, None))
    assert nearvec.near_vectors(frame.where("false")).count() == 0


# --- 6: quality -----------------------------------------------------------------------


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(0)
    words = ["tree", "house", "river", "cloud", "stone", "light"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + "." if i % 3 else "BUY!! " * 20 + "NOW!! $$$ " * rng.randrange(1, 9)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    space = quality.train(docs, labels)
    assert all((r.score >= 0.3) == (r.id % 3 > 0) for r in quality.score(docs, space).collect())
    odd = quality.score(odd_docs, space).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 for r in odd)
    empty = quality.train(no_docs, labels)
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5} and quality.score(no_docs, space).count() == 0


# --- 7: shards ------------------------------------------------------------------------


def smallest(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, parts, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                parts, held = parts + 1, 0
            held += s
        low, high = (low, mid) if parts <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("n, big", [(1, 5), (40, 9), (3000, 10**6), (3000, 10)])
def test_capacity_is_least(spark, n, big):
    rng = random.Random(n)
    groups = sorted((rng.getrandbits(60), rng.randrange(1, 1000) if rng.random() > 0.01 else big) for _ in range(n))
    capacity, begins = shards.cut_points(spark.createDataFrame(groups, "key long, bytes long"), 7)
    held = Counter()
    for key, size in groups:
        held[sum(key >= b for b in begins)] += size
    assert capacity == smallest([s for _, s in groups], 7) == max(held.values())


def test_shards(spark, odd_docs, no_docs):
    rows = shards.shard(odd_docs, 3).collect()
    assert len(rows) == 11 and len({r.shard for r in rows if r.size == 56}) <= 1
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert next(r.size for r in rows if r.id == 3) == 8 and shards.shard(no_docs, 3).count() == 0


# --- 8: secrets -----------------------------------------------------------------------


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{16,}") is True and secrets.trigram_query("a.c") is True
    assert secrets.trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert secrets.trigram_query("(?i:abc|xyz)1?") == ("or", frozenset({"abc", "xyz"}))
    assert secrets.trigram_query("ab[cd]e") == ("or", frozenset({("and", frozenset({"abc", "bce"})), ("and", frozenset({"abd", "bde"}))}))


def test_secrets(spark, odd_docs, no_docs):
    rng = random.Random(4)
    parts = ["password", "token", "api_key", "ApiKey", "secret", '"', "'", " ", ":", "=", "abcdefghijkl", "0123456789abcdef", "AKIA", "ABCDEFGH1234567", "é", "\n", ".", "x", "ghp_" + "a1" * 18]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)]
    rules = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        want = sorted((m.start(), i, k, m.end()) for i, (k, p, g, least) in enumerate(rules) for m in re.finditer(p, texts[r.doc_id]) if len(m[g]) >= least)
        assert [tuple(x) for x in r.found if x.kind in ("assign", "access", "hex")] == want, texts[r.doc_id]
        assert sum(x.kind == "forge" for x in r.found) == len(re.findall("gh[pousr]_[A-Za-z0-9]{36,255}", texts[r.doc_id]))
    assert [len(r.found) for r in secrets.scan(odd_docs).collect()] == [0] * 11 and secrets.scan(no_docs).count() == 0


# --- 9: language ----------------------------------------------------------------------


def test_forward_backward():
    rng = np.random.default_rng(0)
    emission, switch, counts = rng.normal(size=(75, 3)), rng.normal(size=(3, 3)), np.array([70, 5])
    got, _ = langid.marginals(emission, counts, switch)
    at = 0
    for c in counts:
        e = emission[at:at + c]
        ahead, last = [], np.log(np.ones(3) / 3)
        for x in e:
            last = np.logaddexp.reduce(last[:, None] + switch, axis=0) + x
            ahead.append(last)
        rest = [np.zeros(3)]
        for x in e[:0:-1]:
            rest.append(np.logaddexp.reduce(switch + (x + rest[-1])[None, :], axis=1))
        want = np.exp(np.array(ahead) + np.array(rest[::-1]) - np.logaddexp.reduce(ahead[-1]))
        assert np.abs(want - got[at:at + c]).max() < 1e-9
        at += c


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(1)
    vocabulary = {"en": "the of and house river stone was then with this".split(), "de": "der die und haus fluss stein war dann mit dieses".split()}
    rows = [(" ".join(rng.choice(vocabulary[lang]) for _ in range(20)), lang) for lang in ("en", "de") for _ in range(60)]
    tagger = langid.train(rows)
    mixed = spark.createDataFrame([(1, "the house was with this river " * 4 + "der stein und die haus mit fluss " * 4)], "doc_id long, text string")
    labels = langid.predict(mixed, tagger, word_labels=True).first().word_langs
    assert labels[:20] == ["en"] * 20 and labels[-20:] == ["de"] * 20
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, tagger).collect()]
    assert {i for i, p, _ in got if p == "und"} == {3, 4, 5, 8} and all(0 <= s <= 1 for _, _, s in got) and len(got) == 11
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0 and {r.lang_pred for r in langid.predict(odd_docs, langid.train([])).collect()} == {"und"}


def test_long_labelled_texts_are_learned(spark):
    words = {"aa": ["und", "der", "nicht"], "bb": ["the", "of", "and"]}
    rows = [(i, " ".join(words[lang][(i + j) % 3] for j in range(12_000 if lang == "aa" else 20)), lang) for i, lang in enumerate(["aa", "bb"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    tagger = langid.fit(docs)
    assert tagger.labels == ["aa", "bb"]
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, tagger).collect()} == {i: lang for i, _, lang in rows}
    texts = docs.where("lang = 'aa'").unionByName(docs.selectExpr("doc_id + 100 as doc_id", "cast(null as string) as text", "lang"))
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in [*range(0, 12, 2), *range(100, 112)]], "doc_id long, quality int")
    assert sorted(quality.train(texts, labels, sample=6).labels.tolist()) == [0, 0, 0, 1, 1, 1]


# --- 10: BPE --------------------------------------------------------------------------


def test_bpe_round_trip(spark, odd_docs, no_docs):
    with open(PATH, encoding="utf-8") as file:
        model = bpe.Model(file.read())
    coder, peer, rng = bpe.Coder(model), Tokenizer.from_file(PATH), random.Random(1)
    texts = ["", "a<|endoftext|>b  <|endoftext|>", "  \n\n x\t\t y ", "it's they'll 'S", "x" * 5000, "ab" * 3000, " " * 4000 + "z", "²³½ Ⅷ一二 ñé́", "😀" * 300, "!\x1c! a\x85b"]
    texts += ["".join(rng.choice("aeinrstoh") for _ in range(3000)) for _ in range(5)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3000, 0xD000)])) for _ in range(300)) for _ in range(30)]
    texts += ["".join(rng.choice([*"ab .,\n\t'", "the", "  ", "ing", "1"]) for _ in range(400)) for _ in range(30)]
    for t in texts:
        ids = [i for part in coder.encoded(t) for i in part]
        assert ids == peer.encode(t, add_special_tokens=False).ids and "".join(coder.decoded([ids])) == t
    word = "".join(rng.choice(["re", "ation", "the", "in", "er"]) for _ in range(2000)).encode()
    assert list(model.transduced(word, model.lookahead + 129)) == model.merged(word)
    got = {(r.id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(odd_docs, PATH).collect()}
    assert (3, 0, hashlib.sha256(b"").hexdigest()) in got and len(got) == 10
    assert {r.text for r in bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()} == {r.text or "" for r in odd_docs.collect()}
    assert bpe.digests(no_docs, PATH).count() == 0
