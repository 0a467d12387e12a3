"""HTML extraction by layout-aware rendering.

A page is parsed into a tree: tags that HTML lets one leave out are implied, wrongly nested end tags
close what they can.  The tree is then laid out as text: what rules of visibility hide is left out, blocks stand on
lines of their own with the spacing of their kind, white space collapses as in a browser, list items
get markers and indents, and the cells of a table are padded to columns.  Labels of drawings, the symbols of formulas, the values of buttons and what stands in for an object without data are text too.  All other visible text is kept.
Both steps are loops over explicit stacks, so deep nesting is no limit.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import text_steps

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas base link meta param source track area".split())
#: Parts of drawings and formulas that are not shown, and those whose text stands apart from its neighbours.
METADATA = frozenset("annotation annotation-xml defs desc metadata symbol".split())
APART = frozenset("svg text math mfrac mtd".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd tr caption form legend details summary figcaption center option optgroup thead tbody tfoot hgroup search dialog".split())
#: What a start tag ends if it is open, and up to which element that is looked for.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["td", "th", "tr", "caption"]), frozenset(["table"])),
    **{t: (frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(["head"]), frozenset()),
}
#: Elements that an end tag from inside does not close from outside.
WALLS = frozenset(["td", "th", "table", "caption", "button", "object"])
HEAD_ONLY = frozenset("head title meta link style script base template noscript".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:;|!|$)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _tokens(page: str):
    """("start", name, attribute text, closed) | ("end", name) | ("text", raw) of a page, in order."""
    at, size, gone = 0, len(page), set()  # gone: quotes that do not occur any more
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield ("text", page[at:])
            return
        follow = page[begin + 1:begin + 2]
        closing = follow == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if name is None and follow not in ("!", "?", "/"):
            yield ("text", page[at:begin + 1])
            at = begin + 1
            continue
        if begin > at:
            yield ("text", page[at:begin])
        if name is None:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", begin)
                at = size if end < 0 else end + 1
            continue
        stop = name.end()
        while True:
            m = _STOP.search(page, stop)
            if m is None:
                return  # a tag that never ends holds no text
            if m.group() == ">":
                break
            quote = m.group()
            value = page[max(name.end(), m.start() - 64):m.start()].rstrip().endswith("=")  # else the quote is part of a name
            end = page.find(quote, m.end()) if value and quote not in gone else -1
            if value and end < 0:
                gone.add(quote)
            stop = m.end() if end < 0 else end + 1
        tag, inside = name.group().lower(), page[name.end():m.start()]
        at = m.end()
        if closing:
            yield ("end", tag)
            continue
        yield ("start", tag, inside, inside.endswith("/"))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            yield ("text", page[at:end.start() if end else size])
            at = end.start() if end else size


def parse(page: str) -> Node:
    """Tree of a page."""
    root = Node("html", {})
    stack = [root]
    open_count: dict[str, int] = {}

    def close(index: int) -> None:
        for node in stack[index:]:
            open_count[node.tag] -= 1
        del stack[index:]

    def ended(which: frozenset, until: frozenset) -> None:
        """Close the outermost open element of ``which`` above the nearest of ``until``."""
        if not any(open_count.get(t) for t in which):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                break
            if stack[i].tag in which:
                found = i
        if found is not None:
            close(found)

    for token in _tokens(page):
        kind, value = token[0], token[1]
        if kind == "text":
            if open_count.get("head") and stack[-1].tag == "head" and value.strip():
                ended(frozenset(["head"]), frozenset())
            stack[-1].children.append(html.unescape(value) if stack[-1].tag not in ("script", "style") else value)
        elif kind == "start":
            if value == "html":
                continue
            attributes: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(token[2]):
                attributes.setdefault(m.group(1).lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
            if stack[-1].tag == "head" and value not in HEAD_ONLY:
                ended(frozenset(["head"]), frozenset())
            if value in ENDS:
                ended(*ENDS[value])
            if value in BLOCK and value not in ("option", "optgroup"):
                ended(frozenset(["p"]), WALLS)
            if value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})  # an implied row
                stack[-1].children.append(row)
                stack.append(row)
                open_count["tr"] = open_count.get("tr", 0) + 1
            foreign = value in ("svg", "math") or open_count.get("svg") or open_count.get("math")
            if foreign and (value in METADATA or attributes.get("display", "").strip() == "none"):
                attributes["hidden"] = ""
            node = Node(value, attributes)
            stack[-1].children.append(node)
            if value not in VOID and not (token[3] and foreign):
                stack.append(node)
                open_count[value] = open_count.get(value, 0) + 1
        elif value == "br":
            stack[-1].children.append(Node("br", {}))
        elif open_count.get(value):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == value:
                    close(i)
                    break
                if stack[i].tag in WALLS and value not in ("table", "tr", "thead", "tbody", "tfoot"):
                    break
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    return (node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
            or (node.tag == "object" and "data" in a) or (node.tag == "dialog" and "open" not in a) or bool("style" in a and _NOT_SHOWN.search(a["style"])))


class Flow:
    """Lines of a block context: collapses white space, keeps the widest spacing asked for between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.indent, self.marker = 0, [""], ""

    def put(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if not self.now or self.now[-1].endswith((" ", "\n")):
            text = text.removeprefix(" ")
        if text:
            self.now.append(text)

    def finish(self, always: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        if line or always:
            self.row(line)
        self.now = []

    def row(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * max(0, self.gap - 1)
        self.gap = 1
        self.lines.append((self.indent[-2] + self.marker if self.marker else self.indent[-1]) + line)
        self.marker = ""

    def block(self, gap: int) -> None:
        self.finish()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.finish()
        return "\n".join(x.rstrip(" ") for x in self.lines)


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table from rows of (text, columns spanned, rows spanned): each column as wide as its widest line."""
    grid: list[dict[int, list[str]]] = []
    below: dict[int, int] = {}
    width: dict[int, int] = {}
    for row in rows:
        cells, column = {}, 0
        for text, columns, down in row:
            while below.get(column, 0):
                column += 1
            cells[column] = text.split("\n")
            if columns == 1:
                width[column] = max(width.get(column, 0), max(map(len, cells[column])))
            for c in range(column, column + columns):
                below[c] = down
                width.setdefault(c, 0)
            column += columns
        below = {c: n - 1 for c, n in below.items() if n > 1}
        grid.append(cells)
    out = []
    for cells in grid:
        for line in range(max((len(c) for c in cells.values()), default=0)):
            parts, filled = [], 0
            for column in sorted(cells):
                start = sum(width[c] + 2 for c in range(column))
                part = cells[column][line] if line < len(cells[column]) else ""
                if part:
                    parts.append(" " * (start - filled if start > filled or not parts else 2) + part)
                    filled = max(filled, start) + len(part)
            out.append("".join(parts).rstrip())
    return out


def render(page: str | None) -> str:
    """Visible text of a page; empty for null and empty pages."""
    if not page:
        return ""
    flows, tables, lists, verbatim = [Flow()], [], [], 0
    work: list[tuple[str, object]] = [("open", parse(page))]
    while work:
        step, node = work.pop()
        flow = flows[-1]
        if step == "text":
            if not verbatim:
                flow.put(node)
            else:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                if first:
                    flow.now.append(first)
                for line in rest:
                    flow.finish(True)
                    if line:
                        flow.now.append(line)
            continue
        tag = node.tag
        if step == "open":
            if hidden(node):
                continue
            if tag == "br":
                flow.finish(True)
                continue
            if tag in ("input", "img", "wbr"):
                if tag == "input" and node.attributes.get("type", "").lower() in ("button", "submit", "reset"):
                    flow.put(f" {node.attributes.get('value', '')} ")
                continue
            if tag in APART:
                flow.put(" ")
                if tag == "mfrac":  # its parts stand one above the other
                    node.children = [x for child in node.children for x in (child, " ")]
            if tag in ("td", "th") and tables:
                flows.append(Flow())
            elif tag in BLOCK:
                flow.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
            if tag == "hr":
                flow.row("-" * 3)
                flow.gap = 2
                continue
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent.append(flow.indent[-1] + " " * len(marker))
                flow.marker = marker
            elif tag in ("dd", "blockquote"):
                flow.indent.append(flow.indent[-1] + "  ")
            elif tag == "pre":
                verbatim += 1
            work.append(("close", node))
            for child in reversed(node.children):
                work.append(("text", child) if isinstance(child, str) else ("open", child))
            continue
        # The end of an element.
        if tag in ("td", "th") and tables:
            cell = flows.pop().text().strip("\n")
            if not tables[-1]:
                tables[-1].append([])
            spans = [int(v) if re.fullmatch("[1-9][0-9]{0,3}", v := node.attributes.get(k, "1")) else 1 for k in ("colspan", "rowspan")]
            tables[-1][-1].append((cell, *spans))
            continue
        if tag == "table":
            lines = _aligned(tables.pop())
            flow.finish()
            for line in lines:
                flow.row(line)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            flow.finish()
            if flow.marker:
                flow.row("")
            flow.indent.pop()
        elif tag in ("dd", "blockquote"):
            flow.finish()
            flow.indent.pop()
        elif tag == "pre":
            flow.finish()
            verbatim -= 1
        elif tag in APART:
            flow.put(" ")
        if tag in BLOCK:
            flow.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
    while len(flows) > 1:
        flows.pop()
    return flows[0].text().strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row: the visible text of the whole page; empty for null and empty pages.  Ids may be
    null or repeat; further columns are ignored."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).cast("string").alias("text"))

    def step(batches):
        for batch in batches:
            for part in text_steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(t) for t in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(step, "id bigint, text string")
