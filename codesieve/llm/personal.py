"""Personal data with a semi-Markov conditional random field.

The base patterns (fixed values below) find the plain forms.  The field adds what they miss: written-out
addresses, numbers in other groupings.  It labels *segments*, so features see a whole candidate: its digits and
groups, separators, checksum, the word before it, what encloses it.  Segments hold an at-sign (or ``(at)``) or at least
seven digits and have a bounded number of tokens; everything else is outside by construction, so the dynamic programme only
runs over the stretches in which such a segment can lie, with the same result as over the whole text.  It
chooses boundaries and types of a stretch jointly.  The weights maximise the likelihood of the base
spans of a bounded sample, of rewritten copies and of near misses.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import text_sample, text_steps

KINDS = ("email", "ip", "card", "phone")
#: Texts in the sample, and the longest that is taken; stretches of one text that are learned from.
SAMPLE, SAMPLE_CHARS, STRETCHES = 1_500, 20_000, 20
#: Tokens of the longest segment.
SEGMENT = 24

# The base patterns.  Runs are possessive where what follows cannot be part of them.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = re.compile(_LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_AHEAD = re.compile(r"(?<!" + _LOCAL + ")" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
#: Stretches in which a segment can lie.
_AT = r"(?:@|\x20?[(\[]at[)\]]\x20?)"
_DOT = r"(?:\.|\x20?[(\[]dot[)\]]\x20?)"
_STRETCH = re.compile(rf"(?P<mail>{_LOCAL}++{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*)|(?P<digits>\+?\(?[0-9]++(?:[\x20().+-]{{1,2}}[0-9]++)*)")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_WORD_BEFORE = re.compile(r"([A-Za-z]{2,16})[^A-Za-z0-9\n]{0,3}\Z")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches.  A match can begin where the last one ended, or at the begin of a run: a run that
    fails at its begin fails everywhere, so it is not tried again."""
    at = 0
    while "@" in text:
        m = _EMAIL.match(text, at) or _EMAIL_AHEAD.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def _digits_of(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start.  Kinds may overlap."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


@dataclass
class Field:
    """Weights of (kind, feature) and of neighbouring labels; label 0 is outside, then the kinds."""

    weights: dict = field(default_factory=lambda: defaultdict(float))
    switch: list = field(default_factory=lambda: [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)])


def stretches(text: str):
    """(start, end) of stretches that can hold a segment."""
    for m in _STRETCH.finditer(text):
        if m.lastgroup == "mail" or sum(map(len, _DIGITS.findall(m.group()))) >= 7:
            yield m.span()


def _shape(segment: str) -> list[str]:
    groups = _DIGITS.findall(segment)
    digits = "".join(groups)
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", segment))))
    out = ["bias", f"seps={seps[:6]}", f"at={bool(re.search(_AT, segment))}", f"open={segment[0] in '+('}{segment[:2] == '00'}"]
    if "at=True" in out[2]:
        tail = re.split(_DOT, re.split(_AT, segment, maxsplit=1)[1])
        return [*out, f"parts={min(len(tail), 4)}", f"tld={len(tail[-1]) if tail[-1].isalpha() else 0}", f"local={segment[0].isalnum()}"]
    out += [f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}", f"sizes={'-'.join(str(len(g)) for g in groups[:6])}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and seps == ".":
        out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


def segments(text: str, start: int, end: int):
    """Tokens of a stretch as (start, end), and the candidate segments (first token, last + 1, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    before = _WORD_BEFORE.search(text, max(0, start - 24), start)
    word = f"word={before.group(1).lower()}" if before else "word="
    mail = bool(re.search(_AT, text[start:end]))
    out = []
    for i, (a, _) in enumerate(tokens):
        for j in range(i + 1, min(i + SEGMENT, len(tokens)) + 1):
            b = tokens[j - 1][1]
            segment = text[a:b]
            if not segment[-1].isalnum() or not (segment[0].isalnum() or segment[0] in "+("):
                continue
            if (mail and not re.search(_AT, segment)) or (not mail and not 7 <= sum(map(len, _DIGITS.findall(segment))) <= 20):
                continue
            left = text[a - 1:a] or " "
            right = text[b:b + 1] or " "
            features = [*_shape(segment), f"whole={a == start}{b == end}", f"left={_class(left)}", f"right={_class(right)}"]
            out.append((i, j, [*features, word] if a == start else features))
    return tokens, out


def _class(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c if c in "@.+-#*$%&" else "?"


def _scores(own: Field, candidates):
    """Score of each candidate for each kind."""
    w = own.weights
    return [[sum(w.get((k, f), 0.0) for f in features) for k in range(1, len(KINDS) + 1)] for _, _, features in candidates]


def _lattice(n: int, candidates, scores):
    """Segments (first, end, label, score, candidate) by their end; outside segments have one token."""
    by_end = [[(e - 1, e, 0, 0.0, -1)] for e in range(n + 1)]
    for c, (i, j, _) in enumerate(candidates):
        by_end[j] += [(i, j, k + 1, s, c) for k, s in enumerate(scores[c])]
    return by_end


def decode(own: Field, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Best joint segmentation of a stretch: its entities."""
    tokens, candidates = segments(text, start, end)
    if not candidates:
        return []
    n, labels = len(tokens), range(len(KINDS) + 1)
    by_end = _lattice(n, candidates, _scores(own, candidates))
    best = [[-math.inf] * len(labels) for _ in range(n + 1)]
    back: list[list] = [[None] * len(labels) for _ in range(n + 1)]
    best[0][0] = 0.0
    for e in range(1, n + 1):
        for i, _, k, s, _ in by_end[e]:
            value, last = max((best[i][p] + own.switch[p][k], -p) for p in labels)
            if value + s > best[e][k]:
                best[e][k], back[e][k] = value + s, (i, -last)
    e, k = n, max(labels, key=lambda p: best[n][p])
    out = []
    while e > 0:
        i, last = back[e][k]
        if k:
            out.append((KINDS[k - 1], tokens[i][0], tokens[e - 1][1]))
        e, k = i, last
    return out[::-1]


def _log_sum(values) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _learn(own: Field, squares: dict, tokens, candidates, truth: dict, rate: float) -> None:
    """One step up the likelihood of the true segments {(first, end): label} of a stretch."""
    n, labels = len(tokens), range(len(KINDS) + 1)
    by_end = _lattice(n, candidates, _scores(own, candidates))
    ahead = [[-math.inf] * len(labels) for _ in range(n + 1)]
    ahead[0][0] = 0.0
    for e in range(1, n + 1):
        terms = defaultdict(list)
        for i, _, k, s, _ in by_end[e]:
            terms[k] += [ahead[i][p] + own.switch[p][k] + s for p in labels]
        for k, v in terms.items():
            ahead[e][k] = _log_sum(v)
    rest = [[-math.inf] * len(labels) for _ in range(n + 1)]
    rest[n] = [0.0] * len(labels)
    by_begin = defaultdict(list)
    for segs in by_end[1:]:
        for seg in segs:
            by_begin[seg[0]].append(seg)
    for i in range(n - 1, -1, -1):
        for p in labels:
            rest[i][p] = _log_sum([own.switch[p][k] + s + rest[e][k] for _, e, k, s, _ in by_begin[i]])
    z = rest[0][0]
    gradient: dict = defaultdict(float)
    moves = [[0.0] * len(labels) for _ in labels]
    for i in range(n):
        for _, e, k, s, c in by_begin[i]:
            for p in labels:
                chance = ahead[i][p] + own.switch[p][k] + s + rest[e][k] - z
                if chance > -20:
                    chance = math.exp(chance)
                    moves[p][k] -= chance
                    if k:
                        for f in candidates[c][2]:
                            gradient[k, f] -= chance
    place = {(i, j): c for c, (i, j, _) in enumerate(candidates)}
    at, last = 0, 0
    while at < n:
        e, k = next(((j, k) for (i, j), k in truth.items() if i == at), (at + 1, 0))
        moves[last][k] += 1
        if k:
            for f in candidates[place[at, e]][2]:
                gradient[k, f] += 1
        at, last = e, k
    for key, g in gradient.items():
        squares[key] += g * g
        own.weights[key] += rate * g / math.sqrt(squares[key] + 1e-6)
    for p in labels:
        for k in labels:
            own.switch[p][k] += 0.02 * rate * moves[p][k]


def _rewritten(text: str, spans):
    """The text with its addresses written out and its phones with a leading 00, and the spans there."""
    out, moved, at = [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out.append(text[at:a])
        old = text[a:b]
        if kind == "email":
            local, host = old.split("@", 1)
            new = f"{local} (at) {host}" if len(local) % 2 else f"{local}[at]{host.replace('.', '[dot]')}"
        else:
            new = "00" + old[1:] if kind == "phone" else old
        begin = sum(map(len, out))
        out.append(new)
        moved.append((kind, begin, begin + len(new)))
        at = b
    return "".join([*out, text[at:]]), moved


def _near_misses(text: str, spans):
    """The text with each number turned into one that is no personal data: a broken checksum or
    octet, other separators, a phone without its plus."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at or kind == "email":
            continue
        old = text[a:b]
        if kind == "card":
            new = old[:-1] + str((int(old[-1]) + 1 + len(old) % 8) % 10)
        elif kind == "ip":
            new = old.replace(".", "-") if len(old) % 2 else "20" + old[-1] + "1" + "-0" + old[0] + "-1" + old[-1] + " 12"
        else:
            new = old[1:]
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def train(texts: list[str], rounds: int = 3, rate: float = 0.3) -> Field:
    """Fit on the base spans of the texts, of their rewritten copies and of copies with near misses."""
    examples = []
    for text in texts:
        spans = base_spans(text)
        missed = _near_misses(text, spans)
        for own_text, own_spans in ((text, spans), _rewritten(text, spans), (missed, base_spans(missed))):
            for start, end in list(stretches(own_text))[:STRETCHES]:
                tokens, candidates = segments(own_text, start, end)
                first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
                held = {(i, j) for i, j, _ in candidates}
                truth, upto = {}, -1
                for kind, a, b in sorted(own_spans, key=lambda s: s[1]):
                    pair = (first.get(a), last.get(b))
                    if pair in held and pair[0] >= upto:
                        truth[pair] = KINDS.index(kind) + 1
                        upto = pair[1]
                if candidates:
                    examples.append((tokens, candidates, truth))
    own, squares = Field(), defaultdict(float)
    for turn in range(rounds):
        for example in examples:
            _learn(own, squares, *example, rate / (1 + turn))
    return own


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> Field:
    """Train on at most ``sample`` texts with an at-sign or seven digits in a row, chosen by a hash, of at
    most ``max_chars`` characters."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars).where(F.col("text").rlike("@|[0-9]{7}|[+][0-9]"))
    return train([r.text for r in text_sample(rows, sample).orderBy("h").collect()])


def find(own: Field, text: str) -> tuple[list, list]:
    """Base spans and added spans of a text; an added span overlaps no base span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added, at = [], 0
    for start, end in stretches(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        near = []
        for a, b in taken[at:]:
            if a >= end:
                break
            near.append((a, b))
        if any(a <= start and end <= b for a, b in near):
            continue  # nothing of the stretch is left to add
        added += [s for s in decode(own, text, start, end) if not any(s[1] < b and a < s[2] for a, b in near)]
    return base, added


def spans(docs: DataFrame, own: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of every row: arrays of (kind, start, stop), base by kind and start, added by start.

    A null text is empty; ids may be null or repeat; further columns are ignored.  Offsets are code points.
    """
    sent = docs.sparkSession.sparkContext.broadcast((dict(own.weights), own.switch))  # features of a bounded sample
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def step(batches):
        model = Field(*sent.value)
        for batch in batches:
            for part in text_steps(batch):
                found = [find(model, t or "") for t in part.column(1).to_pylist()]
                cols = [pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in f[i]] for f in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", "base", "added"])

    shape = "array<struct<kind:string,start:int,stop:int>>"
    return texts.mapInArrow(step, f"id bigint, base {shape}, added {shape}")
