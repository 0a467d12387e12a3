"""Python patterns as Java patterns with the same matches, written from the parsed tree.

Every element is spelled out (classes, anchors, word edges), so the Java pattern needs no flag but that for
ignoring case.  A group whose place is asked for gets the text before and after it inside the match as groups
of its own: their lengths give its position, wherever else its text occurs.  What Java has no equal form for, or would
run by recursion over a long text, raises ``Untranslatable`` with the reason; such patterns run in Python.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from re import _constants as _c
from re import _parser as _p

#: More repeats than this count as unbounded.
MANY = 1000

_WORD = {False: r"\p{L}\p{N}_", True: "a-zA-Z0-9_"}
_DIGIT = {False: r"\p{Nd}", True: "0-9"}
_SPACE = {False: r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", True: r"\t-\r\x20"}
# by name: the constants themselves cannot be pickled, and tasks take these functions by value
_CLASSES = {"CATEGORY_WORD": _WORD, "CATEGORY_DIGIT": _DIGIT, "CATEGORY_SPACE": _SPACE}
_NOT_CLASSES = {"CATEGORY_NOT_WORD": _WORD, "CATEGORY_NOT_DIGIT": _DIGIT, "CATEGORY_NOT_SPACE": _SPACE}
_REPEATS = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}
_SINGLE = ("LITERAL", "NOT_LITERAL", "IN", "ANY")


class Untranslatable(ValueError):
    """No Java pattern has the same matches; the text says why."""


@dataclass(frozen=True)
class Translated:
    """A Java pattern; the groups whose texts, joined, lie before and after the asked group inside the match."""

    java: str
    own: int = 0
    before: tuple[int, ...] = ()
    after: tuple[int, ...] = ()


def parsed(pattern: str, flags: int = 0):
    """The tree of a pattern; its flags, those of a leading ``(?...)`` included, are ``.state.flags``."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _p.parse(pattern, flags)


def has_scoped_flags(items) -> bool:
    """True when flags change inside the pattern."""
    return any(
        (op is _c.SUBPATTERN and (av[1] or av[2])) or any(has_scoped_flags(x) for x in _inner(op, av)) for op, av in items)


def _inner(op, av) -> list:
    if op is _c.SUBPATTERN:
        return [av[3]]
    if op.name in _REPEATS:
        return [av[2]]
    if op is _c.BRANCH:
        return list(av[1])
    if op in (_c.ASSERT, _c.ASSERT_NOT):
        return [av[1]]
    if op is _c.ATOMIC_GROUP:
        return [av]
    if op is _c.GROUPREF_EXISTS:
        return [x for x in av[1:] if x is not None]
    return []


def _groups(items) -> set[int]:
    """Numbers of the groups inside."""
    own = {av[0] for op, av in items if op is _c.SUBPATTERN and av[0] is not None}
    return own.union(*(_groups(x) for op, av in items for x in _inner(op, av)))


def _even(items) -> bool:
    """True when all matches have one length and there is one way to find them, so that Java repeats it in a loop."""
    return all(
        op.name in _SINGLE or op is _c.AT or (op is _c.SUBPATTERN and _even(av[3])) or (op.name in _REPEATS and av[0] == av[1] and _even(av[2])) for op, av in items)


def _char(code: int) -> str:
    c = chr(code)
    if c.isascii():
        return c if c.isalnum() else "\\" + c if c.isprintable() and c != " " else f"\\x{code:02x}"
    return f"\\x{{{code:x}}}"


def _is_word(code: int, ascii_only: bool) -> bool:
    c = chr(code)
    return c == "_" or (c.isalnum() and (c.isascii() or not ascii_only))


def _edge(items, ascii_only: bool, first: bool) -> bool | None:
    """Whether a match of the items surely begins (ends) with a word character; None if that is open."""
    for op, av in items if first else reversed(items):
        if op is _c.LITERAL:
            return _is_word(av, ascii_only)
        if op is _c.IN:
            kinds = set()
            for kind, value in av:
                if kind is _c.LITERAL:
                    kinds.add(_is_word(value, ascii_only))
                elif kind is _c.RANGE and value[1] - value[0] < 256:
                    kinds |= {_is_word(x, ascii_only) for x in range(value[0], value[1] + 1)}
                elif kind is _c.CATEGORY and value in (_c.CATEGORY_WORD, _c.CATEGORY_DIGIT):
                    kinds.add(True)
                elif kind is _c.CATEGORY and value in (_c.CATEGORY_SPACE, _c.CATEGORY_NOT_WORD):
                    kinds.add(False)
                else:
                    return None
            return kinds.pop() if len(kinds) == 1 else None
        if op is _c.SUBPATTERN and not (av[1] or av[2]) and len(av[3]):
            return _edge(av[3], ascii_only, first)
        if op.name in _REPEATS and av[0] >= 1 and len(av[2]):
            return _edge(av[2], ascii_only, first)
        if op is _c.BRANCH:
            kinds = {_edge(b, ascii_only, first) for b in av[1]}
            return kinds.pop() if len(kinds) == 1 else None
        return None
    return None


class _Writer:
    def __init__(self, group: int):
        self.group, self.count = group, 0
        self.numbers: dict[int, int] = {}
        self.before: list[int] = []
        self.after: list[int] = []

    def _open(self) -> int:
        self.count += 1
        return self.count

    def sequence(self, items, flags: int, behind: bool = False) -> str:
        items = list(items)
        at = next((i for i, (op, av) in enumerate(items) if self.group and any(self.group in _groups(x) or (op is _c.SUBPATTERN and av[0] == self.group) for x in _inner(op, av))), None)
        if at is None:
            return "".join(self.item(items, i, flags, behind) for i in range(len(items)))
        op, av = items[at]
        if op is not _c.SUBPATTERN and op is not _c.ATOMIC_GROUP:
            raise Untranslatable("the group may be missing or repeated")
        text = self._apart(items, range(at), flags, self.before)
        text += self.item(items, at, flags, behind)
        return text + self._apart(items, range(at + 1, len(items)), flags, self.after)

    def _apart(self, items, places: range, flags: int, into: list[int]) -> str:
        """Some of the items as a group of their own."""
        if not places:
            return ""
        into.append(self._open())
        return "(" + "".join(self.item(items, i, flags, False) for i in places) + ")"

    def item(self, items, i: int, flags: int, behind: bool) -> str:
        op, av = items[i]
        ascii_only, any_case = bool(flags & re.A), bool(flags & re.I)
        if op is _c.LITERAL:
            return _char(av)
        if op is _c.NOT_LITERAL:
            return f"[^{_char(av)}]"
        if op is _c.ANY:
            return "(?s:.)" if flags & re.S else r"[^\n]"
        if op is _c.IN:
            return _class(av, ascii_only)
        if op is _c.AT:
            return self._anchor(av, items, i, flags)
        if op is _c.BRANCH:
            return "(?:" + "|".join(self.sequence(b, flags, behind) for b in av[1]) + ")"
        if op is _c.SUBPATTERN:
            group, add, remove, inner = av
            here = (flags | add) & ~remove
            if group is None:
                change = (here ^ flags) & (re.I | re.A) if (here | flags) & re.I else 0
                return f"(?{_case(here) if change else ''}:{self.sequence(inner, here, behind)})"
            self.numbers[group] = self._open()
            if group == self.group:
                return f"({''.join(self.item(list(inner), k, here, behind) for k in range(len(inner)))})"
            return f"({self.sequence(inner, here, behind)})"
        if op is _c.ATOMIC_GROUP:
            return f"(?>{self.sequence(av, flags, behind)})"
        if op in (_c.ASSERT, _c.ASSERT_NOT):
            sign = "=" if op is _c.ASSERT else "!"
            return f"(?{'<' if av[0] < 0 else ''}{sign}{self.sequence(av[1], flags, av[0] < 0)})"
        if op is _c.FAILURE:
            return "(?!)"
        if op is _c.GROUPREF:
            if behind:
                raise Untranslatable("a look-behind names a group")
            if any_case and ascii_only:
                raise Untranslatable("a group is named regardless of ASCII case")
            return f"(?:\\{self.numbers[av]})"
        if op.name in _REPEATS:
            low, high, inner = av
            if high > 1 and inner.getwidth()[0] == 0:
                raise Untranslatable("what is repeated may be empty")
            if high > MANY and not _even(inner):
                raise Untranslatable("Java would repeat it by recursion")
            body = self.sequence(inner, flags, behind)
            if len(inner) != 1 or inner[0][0].name not in (*_SINGLE, "SUBPATTERN", "BRANCH", "ATOMIC_GROUP"):
                body = f"(?:{body})"
            times = {(0, 1): "?", (0, _c.MAXREPEAT): "*", (1, _c.MAXREPEAT): "+"}.get((low, high))
            if times is None:
                times = "{%d}" % low if low == high else "{%d,}" % low if high == _c.MAXREPEAT else "{%d,%d}" % (low, high)
            return body + times + _REPEATS[op.name]
        raise Untranslatable("it asks whether a group was found" if op is _c.GROUPREF_EXISTS else f"unknown element {op}")

    def _anchor(self, where, items, i: int, flags: int) -> str:
        if where in (_c.AT_BEGINNING, _c.AT_BEGINNING_STRING):
            return r"(?<![^\n])" if flags & re.M and where is _c.AT_BEGINNING else r"\A"
        if where is _c.AT_END_STRING:
            return r"\z"
        if where is _c.AT_END:
            return r"(?![^\n])" if flags & re.M else r"(?=\n?\z)"
        ascii_only = bool(flags & re.A)
        word = f"[{_WORD[ascii_only]}]"
        if where is _c.AT_BOUNDARY:
            after, before = _edge(items[i + 1:], ascii_only, True), _edge(items[:i], ascii_only, False)
            if after is not None:
                return f"(?<!{word})" if after else f"(?<={word})"
            if before is not None:
                return f"(?!{word})" if before else f"(?={word})"
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        return rf"(?!\A\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"


def _class(members, ascii_only: bool) -> str:
    """A class of characters.  A negated one with a negated class inside becomes a look-ahead, as Java versions differ on it."""
    negated, nested, parts = False, False, []
    for kind, value in members:
        if kind is _c.NEGATE:
            negated = True
        elif kind is _c.LITERAL:
            parts.append(_char(value))
        elif kind is _c.RANGE:
            parts.append(f"{_char(value[0])}-{_char(value[1])}")
        elif value.name in _CLASSES:
            parts.append(_CLASSES[value.name][ascii_only])
        else:
            nested = True
            parts.append(f"[^{_NOT_CLASSES[value.name][ascii_only]}]")
    if not negated:
        return f"[{''.join(parts)}]"
    return f"(?:(?![{''.join(parts)}])(?s:.))" if nested else f"[^{''.join(parts)}]"


def _case(flags: int) -> str:
    return "-iu" if not flags & re.I else "i-u" if flags & re.A else "iu"


def translate(pattern: str, flags: int = 0, group: int = 0) -> Translated:
    """The Java pattern that matches as ``re`` does on text, and the groups around ``group``."""
    tree = parsed(pattern, flags)
    if group and group >= tree.state.groups:
        raise re.error("no such group")
    writer = _Writer(group)
    all_flags = tree.state.flags
    body = writer.sequence(tree, all_flags)
    lead = {"iu": "(?iu)", "i-u": "(?i)"}.get(_case(all_flags), "")
    return Translated(lead + body, writer.numbers.get(group, 0), tuple(writer.before), tuple(writer.after))


def python_reason(pattern: str, flags: int = 0, group: int = 0) -> str | None:
    """Why spans of a pattern need Python's ``re``; None if Java finds them."""
    if parsed(pattern, flags).getwidth()[0] == 0:
        return "it may match the empty text"
    try:
        translate(pattern, flags, group)
    except Untranslatable as e:
        return str(e)
    return None
