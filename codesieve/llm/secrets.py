"""Secret scan with a trigram inverted index, on DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: alternatives are ORed, the
trigrams of a literal stretch are ANDed, and whatever has no literal of three characters asks for nothing.
The index holds, for each trigram that some query names, the rows whose lower-cased text has it.
Posting lists are combined per row as bits, the queries pick candidates, and only those are verified with the
regular expression itself.  A rule whose query is empty reads every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.regex import mark_sql, spans_sql, sql_str
from codesieve.llm.common import written

#: Literal strings that a stretch may stand for before it is closed.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common subset of Python and Java; a match counts if ``group`` has ``least`` characters.
    A scan takes up to 63 rules."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# A private key runs from its BEGIN line over everything but five dashes to its END line.  Without one it runs over header
# lines, long base64 runs with line breaks (also escaped ones), quotes and blanks between them, and short base64 lines that follow at once.
# Possessive loops only, so long keys need no stack.
_KEY = r"[A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----"
_TO_END = rf"[^-]*+(?:-(?!----)[^-]*+)*+-----END {_KEY}"
_NEW_LINE = r"[ \t]*+(?:\r\n|\r|\n|\\r\\n|\\n|\\r)"
_HEADER = rf"{_NEW_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*+"
_LONG_RUN = r"""(?:[\s"',;+>|#*]|\\[nrt])*+[A-Za-z0-9+/=]{24,}"""
_SHORT_LINE = rf"""{_NEW_LINE}[ \t"',;>|#*]*+[A-Za-z0-9+/=]++(?=[ \t"',;+)]*+(?![^\r\n\\]))"""
_NO_END = rf"(?:{_HEADER})*+(?:{_LONG_RUN}|{_SHORT_LINE})*+"

#: The three base rules, then the rules that add spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 0, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", rf"-----BEGIN {_KEY}(?:{_TO_END}|{_NO_END})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)

# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
_NEVER = ("or", frozenset())


def _both(parts) -> object:
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    flat.discard(True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _either(parts) -> object:
    """One of the parts; a part that demands more than another is absorbed by it."""
    flat = set(parts)
    if True in flat or not flat:
        return True
    plain = {q: frozenset([q]) if isinstance(q, str) else q[1] for q in flat if isinstance(q, str) or q[0] == "and"}
    flat -= {q for q in plain if any(plain[o] < plain[q] for o in plain)}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_strings(strings: set[str]) -> object:
    return _either(_both(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes, strings: set[str], asked: list) -> set[str]:
    """Follow a sequence of the parsed pattern: ``strings`` is what the open literal stretch can be;
    demands of closed stretches go to ``asked``.  The new open stretch is returned."""
    for op, value in nodes:
        name = str(op)
        options: set[str] | None = None
        if name == "LITERAL":
            options = {chr(value).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            options = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            strings = _walk(value[3], strings, asked)
            continue
        elif name == "BRANCH":
            ends, demands, same = set(), [], True
            for branch in value[1]:
                own: list = []
                end = _walk(branch, {""}, own)
                same = same and not own
                ends |= end
                demands.append(_both([*own, _of_strings(end)]))
            if same:
                options = ends
            else:
                asked.append(_either(demands))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == 0 and value[1] == 1:
            own = []
            options = _walk(value[2], {""}, own) | {""}
            if own:
                options = None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == value[1] and value[0] <= 8:
            for _ in range(value[0]):
                strings = _walk(value[2], strings, asked)
            continue
        elif name == "AT":
            continue
        if options is not None and len(strings) * len(options) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, options)}
        else:
            asked.append(_of_strings(strings))
            strings = options if options is not None else {""}
    return strings


def trigram_query(pattern: str) -> object:
    """Demand that the lower-cased text of every match fulfils; True if there is none.  Only ASCII
    patterns are analysed, others ask for nothing."""
    if not pattern.isascii():
        return True
    asked: list = []
    end = _walk(re._parser.parse(pattern), {""}, asked)
    return _both([*asked, _of_strings(end)])


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _holds(query: object, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    every = query[0] == "and"
    out = F.lit(every)
    for q in sorted(query[1], key=repr):
        out = out & _holds(q, has) if every else out | _holds(q, has)
    return out


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Posting rows (trigram, row) of the texts (row, text), written to the shared folder."""
    lower = F.col("lower")
    found = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(i).cast("smallint")) for i, t in enumerate(trigrams)]))
    return written(texts.select("row", F.lower("text").alias("lower")).select(F.explode(found).alias("trigram"), "row"))


def candidates(index: DataFrame, queries: list[object], trigrams: list[str]) -> DataFrame:
    """(row, rules): bit r is set if the row's postings fulfil query r."""
    words = -(-len(trigrams) // 62)
    bits = [F.bit_or(F.expr(f"CASE WHEN trigram div 62 = {w} THEN shiftleft(1L, trigram % 62) ELSE 0L END")).alias(f"b{w}") for w in range(words)]
    held = index.groupBy("row").agg(*bits)

    def has(t):
        w, b = divmod(trigrams.index(t), 62)
        return F.col(f"b{w}").bitwiseAND(F.lit(1 << b).cast("bigint")) != 0

    rules = sum([F.when(_holds(q, has), F.lit(1 << r).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for r, q in enumerate(queries)], F.lit(0).cast("bigint"))
    return held.select("row", rules.alias("rules")).where("rules <> 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (the id by default) and ``found``: an array of (start, kind_order, kind, stop) of
    every row, in that order; start and stop count code points, stop exclusive.

    Matches of a rule are leftmost and do not overlap; those with a too short group are dropped and not tried again.
    Null and empty texts have none.  Ids may be null or repeat: rows are told apart by a hash of id and text, and a
    clash of hashes only adds candidates.
    """
    names = keep or [id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    if trigrams:
        picked = candidates(build_index(texts.select("row", "text"), trigrams), [q if q is not True else _NEVER for q in queries], trigrams)
        texts = texts.join(picked, "row", "left")
    else:
        texts = texts.withColumn("rules", F.lit(0).cast("bigint"))
    texts = texts.withColumn("rules", F.coalesce("rules", F.lit(0).cast("bigint"))).withColumn("mark", F.expr(mark_sql("text")))
    arrays = []
    for r, rule in enumerate(rules):
        pattern = sql_str(rule.pattern)
        due = f"text rlike {pattern}" if queries[r] is True else f"(rules & {1 << r}L) <> 0 AND text rlike {pattern}"
        long_enough = f"length(regexp_extract(x.m, {pattern}, {rule.group})) >= {rule.least}" if rule.least else "true"
        arrays.append(f"CASE WHEN {due} THEN transform(filter({spans_sql('text', pattern)}, x -> {long_enough}),"
                      f" x -> struct(x.start as start, {r} as kind_order, {sql_str(rule.kind)} as kind, x.end as stop)) END")
    none = "cast(array() as array<struct<start:int,kind_order:int,kind:string,stop:int>>)"
    found = F.expr(f"array_sort(concat({', '.join(f'coalesce({a}, {none})' for a in arrays)}))")
    return texts.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], found.alias("found"))


def joined(found: str, kinds: list[str] | None = None) -> Column:
    """``kind:start:stop`` of the spans (of some kinds), comma-joined in their order."""
    chosen = F.expr(f"filter({found}, x -> x.kind in ({', '.join(map(sql_str, kinds))}))") if kinds else F.col(found)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
