"""Regex helpers: Python syntax to Java syntax, gates, and native span extraction.

Patterns are stated once in Python syntax.  A span is (match, group, start, end) in code
points, extracted inside the JVM from ``regexp_extract_all`` and ``split``; a cheap byte search
for the literals a pattern cannot match without (its gate) runs first, so that the regex engine
only sees the few texts that may hold a match.
"""

from __future__ import annotations

import re
from re import _constants as _c

from codesieve.functions.pattern import has_scoped_flags, parsed, translate

# Letters that fold to an ASCII letter under ignore-case but are not changed by lower():
# long s, dotted capital I, dotless i.  Texts with one of them skip the lower-case gates.
ODD_FOLDS = ["\u017f", "\u0130", "\u0131"]

_CHUNK = 128


def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    out = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + out.replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0") + "'"


def flags_of(ignore_case: bool = False, multiline: bool = False) -> int:
    return (re.I if ignore_case else 0) | (re.M if multiline else 0)


def java_pattern(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The Java pattern with the same matches as Python's ``re`` on text; raises ``Untranslatable`` if there is none."""
    return translate(pattern, flags_of(ignore_case, multiline)).java


def may_match_empty(pattern: str) -> bool:
    """True when the shortest match is empty, so that spans need the Python twin."""
    return parsed(pattern).getwidth()[0] == 0


def _sequence_gates(seq) -> tuple[list[list[str]], bool]:
    """Literal runs of a parsed sequence as a conjunction of alternatives; pure = nothing else."""
    gates: list[list[str]] = []
    run, pure = "", True

    def close():
        nonlocal run
        if run:
            gates.append([run])
        run = ""

    for op, av in seq:
        if op is _c.LITERAL:
            run += chr(av)
        elif op is _c.AT:
            pure = False
        elif op is _c.SUBPATTERN:
            inner, inner_pure = _sequence_gates(av[3])
            pure &= inner_pure and len(seq) == 1
            if len(inner) == 1 and len(inner[0]) == 1 and inner_pure:
                run += inner[0][0]
            else:
                close()
                gates += inner
        elif op is _c.BRANCH:
            branches = [_sequence_gates(b) for b in av[1]]
            prefix = run
            close()
            alternatives = [max(g, key=lambda a: min(map(len, a))) if g else None for g, _ in branches]
            whole = all(p and len(g) <= 1 for g, p in branches)
            if all(a is not None for a in alternatives):
                merged = [lit for a in alternatives for lit in a]
                if prefix and whole:
                    gates.pop()
                    merged = [prefix + lit for lit in merged]
                    gates.append(merged)
                else:
                    gates.append(merged)
            pure &= whole and None not in alternatives and len(seq) <= 1 + len(prefix)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and av[0] >= 1:
            close()
            inner, _ = _sequence_gates(av[2])
            gates += inner
            pure = False
        else:
            close()
            pure = False
    close()
    return gates, pure and len(gates) <= 1


def required_literals(pattern: str) -> tuple[list[list[str]], bool]:
    """Literals every match contains: all groups must occur, one alternative of each suffices.

    The second value is True when an occurrence is also sufficient for a match.
    """
    gates, pure = _sequence_gates(list(parsed(pattern)))
    long_enough = [g for g in gates if min(map(len, g)) >= 2]
    return (long_enough or gates), pure


def gate_sql(pattern: str, ignore_case: bool = False, code: str = "code", lowered: str = "hay", odd: str = "odd") -> tuple[str, bool]:
    """A SQL condition that holds whenever the pattern matches; True when it is also sufficient."""
    tree = parsed(pattern)
    gates, pure = required_literals(pattern)
    fold = ignore_case or bool(tree.state.flags & re.I)
    if not gates or has_scoped_flags(tree) or (fold and any(not lit.isascii() for g in gates for lit in g)):
        return "true", False
    column = lowered if fold else code
    text = " AND ".join(
        "(" + " OR ".join(
            f"contains({column}, {sql_str(lit.lower() if fold else lit)})" for lit in dict.fromkeys(g)
        ) + ")"
        for g in gates
    )
    return (f"({odd} OR ({text}))" if fold else f"({text})"), pure and not fold


# Rough share of characters in prose and code, in permille; others count as 5.
_SHARE = {
    " ": 150, "e": 100, "t": 75, "a": 65, "i": 60, "n": 60, "o": 60, "r": 55, "s": 55, "h": 40, "d": 35, "l": 35, "u": 25, "c": 25, "m": 20,
    "f": 18, "w": 18, "g": 16, "p": 17, "y": 15, "b": 12, ".": 12, "v": 9, "k": 6, "(": 6, "_": 6, "-": 4, "x": 2, "j": 2, "q": 1, "z": 1,
}
_TOKEN = 10


def _starts(literal: str) -> range:
    """Positions where a token may start: at least three characters must follow, if there are any."""
    return range(max(1, len(literal) - 2))


def choose_tokens(literals: list[str]) -> dict[str, str]:
    """A short part of each lower-cased literal; together they start with few and rare characters.

    Greedy cover: take the character that reaches most literals for its share of all text.
    """
    low = {lit: lit.lower() for lit in dict.fromkeys(literals)}
    chosen: dict[str, str] = {}
    while len(chosen) < len(low):
        reach: dict[str, int] = {}
        for lit in low:
            if lit not in chosen:
                for c in {low[lit][k] for k in _starts(lit)}:
                    reach[c] = reach.get(c, 0) + 1
        best = max(sorted(reach), key=lambda c: reach[c] / _SHARE.get(c, 5))
        for lit in low:
            at = next((k for k in _starts(lit) if low[lit][k] == best), None)
            if lit not in chosen and at is not None:
                chosen[lit] = low[lit][at:at + _TOKEN]
    return chosen


def token_literals(pattern: str) -> list[str] | None:
    """Literals of which at least one occurs in every match, regardless of case; None if unknown."""
    if has_scoped_flags(parsed(pattern)):
        return None
    gates = [g for g in required_literals(pattern)[0] if all(lit.isascii() for lit in g)]
    if not gates:
        return None
    return min(gates, key=lambda g: (len(g), -min(map(len, g))))


def token_scan_regex(tokens: list[str]) -> str:
    """Java pattern whose group 1, over all positions of a text, lists the tokens that occur.

    The search is a lookahead, so overlapping tokens are all seen; at one position the longest is
    reported and stands for the tokens that are its prefixes.
    """
    heads: dict[str, list[str]] = {}
    for token in sorted(set(tokens), key=lambda t: (-len(t), t)):
        heads.setdefault(token[0], []).append(token[1:])
    branches = "|".join(re.escape(h) + "(?:" + "|".join(re.escape(rest) for rest in rests) + ")" for h, rests in sorted(heads.items()))
    first = "".join("\\" + h if not h.isalnum() and h != " " else h for h in sorted(heads))
    return f"(?=[{first}])(?=({branches}))"


def token_condition(wanted: list[str], tokens: list[str], found: str = "found") -> str:
    """SQL condition: one of the wanted tokens was reported, itself or as a prefix of a longer one."""
    reported = [t for t in dict.fromkeys(tokens) if any(t.startswith(w) for w in wanted)]
    return "(" + " OR ".join(f"array_contains({found}, {sql_str(t)})" for t in reported) + ")"


def running_sums_sql(values: str) -> str:
    """struct(d, o): the values and the total before each chunk of them.

    ``before(i)`` of the pair is ``o[i div chunk]`` plus the values of the chunk before ``i``: the
    work stays near linear, where a running total appended to an array copies it every time.
    """
    add = "0L, (a, b) -> a + b"
    chunk_sums = (
        f"transform(array({values}), d -> named_struct('d', d, 'c', transform("
        f"sequence(0, cast(size(d) div {_CHUNK} as int)), j -> aggregate(slice(d, j * {_CHUNK} + 1, {_CHUNK}), {add}))))"
    )
    return (
        f"transform({chunk_sums}, v -> named_struct('d', v.d, 'o',"
        f" transform(v.c, (y, j) -> aggregate(slice(v.c, 1, j), {add}))))[0]"
    )


def sum_before_sql(pair: str, i: str) -> str:
    """Sum of the values before index ``i`` of a ``running_sums_sql`` pair."""
    at = f"cast({i} div {_CHUNK} as int)"
    return f"({pair}.o[{at}] + aggregate(slice({pair}.d, {at} * {_CHUNK} + 1, {i} % {_CHUNK}), 0L, (a, b) -> a + b))"


def _measure(text: str) -> str:
    """Length and line feeds of a text in one number, so that one running sum serves both.

    A line feed is one byte, so bytes, which need no walk over the text, count line feeds as characters do.
    """
    return f"(length({text}) + shiftleft(cast(octet_length({text}) - octet_length(replace({text}, '\\n', '')) as bigint), 32))"


def _two_pass_spans_sql(code: str, pattern: str, own: str, before: str) -> str:
    """The same for texts that hold all marks: matches and the texts between them from two passes."""
    found = (
        f"transform(array(named_struct('m', regexp_extract_all({code}, {pattern}, 0), 'g', regexp_extract_all({code}, {pattern}, {own}),"
        f" 'h', transform(coalesce({before}, array()), n -> regexp_extract_all({code}, {pattern}, n)),"
        f" 's', transform(split({code}, {pattern}, -1), x -> {_measure('x')}))),"
        f" v -> named_struct('m', v.m, 'g', v.g, 'h', v.h, 's', v.s, 'r',"
        f" {running_sums_sql('transform(v.m, (x, i) -> ' + _measure('x') + ' + v.s[i])')}))"
    )
    placed = (
        f"transform({found}, v -> transform(v.m, (x, i) -> named_struct('m', x, 'g', v.g[i],"
        f" 'b', {sum_before_sql('v.r', 'i')} + v.s[i] + aggregate(v.h, 0L, (a, y) -> a + {_measure('y[i]')}))))[0]"
    )
    start = "cast(x.b & 4294967295L as int)"
    return (
        f"transform({placed}, x -> named_struct('m', x.m, 'g', x.g, 'start', {start},"
        f" 'end', {start} + length(x.g), 'line', cast(shiftright(x.b, 32) + 1 as int)))"
    )


_MARKS = ["\x01", "\x02", "\x03", "\x04"]


def mark_sql(code: str) -> str:
    """A control character that does not occur in the text; null when all candidates do."""
    return "CASE " + " ".join(f"WHEN NOT contains({code}, '\\u{ord(m):04x}') THEN '\\u{ord(m):04x}'" for m in _MARKS) + " END"


def spans_sql(code: str, pattern: str, own: str = "0", before: str = "array()", after: str = "array()", mark: str = "mark") -> str:
    """Array of struct(m, g, start, end, line) of all matches, left to right; start and end are those of g.

    ``pattern`` and the groups of its ``Translated`` form are SQL expressions: literals or columns.  With 0 as ``own`` the
    span is the whole match and ``g`` equals ``m``.  One regex pass puts ``mark`` (see ``mark_sql``) around each
    match, or around its parts before, in and after the group; a plain split then gives all parts in turn, and offsets and
    lines are running sums over them.
    """
    def texts(groups: str) -> str:
        return f"array_join(transform(coalesce({groups}, array()), n -> concat('$', cast(n as string))), '')"

    grouped = f"concat({mark}, {texts(before)}, {mark}, '$', cast({own} as string), {mark}, {texts(after)}, {mark})"
    whole = f"concat({mark}, '$0', {mark})"
    put, step, match = whole, "2", "v.p[i]"
    if own != "0":
        put, step = f"CASE WHEN {own} = 0 THEN {whole} ELSE {grouped} END", f"CASE WHEN {own} = 0 THEN 2 ELSE 4 END"
        match = f"CASE WHEN {own} = 0 THEN v.p[i] ELSE concat(v.p[i - 1], v.p[i], v.p[i + 1]) END"
    parts = f"split(regexp_replace({code}, {pattern}, {put}), {mark}, -1)"
    summed = (
        f"transform(array({parts}), p -> named_struct('p', p, 'r',"
        f" {running_sums_sql('transform(p, x -> ' + _measure('x') + ')')}))"
    )
    places = f"filter(sequence(0, size(v.p) - 1), i -> i % ({step}) = ({step}) div 2)"
    found = f"transform({summed}, v -> transform({places}, i -> named_struct('m', {match}, 'g', v.p[i], 'b', {sum_before_sql('v.r', 'i')})))[0]"
    start = "cast(x.b & 4294967295L as int)"
    marked = (
        f"transform({found}, x -> named_struct('m', x.m, 'g', x.g, 'start', {start},"
        f" 'end', {start} + length(x.g), 'line', cast(shiftright(x.b, 32) + 1 as int)))"
    )
    return f"CASE WHEN {mark} IS NULL THEN {_two_pass_spans_sql(code, pattern, own, before)} ELSE {marked} END"


def python_spans(pattern: str, text: str, group: int = 0, flags: int = 0) -> list[tuple[str, int, int]]:
    """Plain ``re.finditer`` spans: used in tests and for patterns that may match empty."""
    return [(m.group(0), m.start(group), m.end(group)) for m in re.finditer(pattern, text, flags)]
