"""Layout-aware text of HTML pages.

A tokenizer that only moves forward and a tree builder (implied start and end tags,
raw-text elements, void elements, stray end tags) make a tree of any depth; visibility rules
drop what a browser would not show (of a closed list of choices all but the chosen one, of
closed details all but the summary; rules of ``style`` elements with one tag, class or
identifier as selector count, others do not); a renderer writes the rest as text: blocks on lines of their own, blank lines
where paragraphs, headings, lists and tables meet their neighbours, list markers with
indentation, ``pre`` as it stands, and table cells padded so that columns line up. Wide
characters count two columns.

Output and time grow with the page: indentation stops at ``INDENT`` columns, padding puts no
cell further right than ``PAD``, and tables within ``NESTED`` others are written row by row
without padding.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.blocks import quoted
from lexspan.session import ship, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?+)?+")
_WHITE = re.compile(r"[ \t\n\r\f]+")
#: Elements that may end themselves: ``<path/>``.
_FOREIGN = frozenset("svg path g circle rect line polygon polyline ellipse use stop image mspace mprescripts none math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that show nothing.
_UNSEEN = frozenset("head script style title template meta link base iframe noembed noframes object audio video canvas datalist area param source track desc defs metadata symbol annotation annotation-xml".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul caption tr tbody thead tfoot xmp".split())
#: Blocks that a blank line parts from their neighbours.
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure ol ul dir menu pre table hr xmp".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "tr", "tbody", "thead", "tfoot", "optgroup", "legend", "summary"} | {"summary"}
#: A start tag closes an open element of these names, unless one of the second names stands between.
_IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
    "body": (("head",), ()),
}
_HEAD_ONLY = frozenset("title meta link base style script template noscript bgsound basefont".split())
#: Where these open elements end, so does the search for an end tag's start tag.
_SCOPES = frozenset("table td th caption template html".split())
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)", re.I)
#: A selector of a tag, a class or an identifier, or a tag with one of these.
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
INDENT, PAD, NESTED = 40, 400, 16


class Node:
    __slots__ = ("name", "attrs", "children", "style")

    def __init__(self, name: str, attrs: list[tuple[str, str]] | None = None):
        self.name, self.attrs, self.children, self.style = name, attrs, [], {}

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v) for k, v in reversed(self.attrs)} if self.attrs else {}


def _tag(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Attributes from ``at`` and where the tag ends; -1 if the page ends within it. Only ever moves forward."""
    attrs = []
    while True:
        m = _ATTRIBUTE.match(page, at)
        name, quote, value = m.groups()
        at = m.end()
        if quote:
            end = page.find(quote, at)
            if end < 0:
                return attrs, -1
            value, at = page[at:end], end + 1
        if name:
            attrs.append((name, value or ""))
        elif page[at : at + 1] == ">":
            return attrs, at + 1
        elif at >= len(page):
            return attrs, -1


class _Open:
    """The open elements, and for each name where it stands among them, so that no look-up walks the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.deepest = [root], {}, 1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)
        self.deepest = max(self.deepest, len(self.stack))

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The innermost open element of one of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """End all open elements of ``names`` that stand within the innermost of ``stops``."""
        stop = self.last(stops)
        first = min((p for n in names for p in self.places.get(n, ())[_after(self.places.get(n, ()), stop) :][:1]), default=0)
        if first:
            self.cut(first)


def _after(places, stop: int) -> int:
    return bisect_right(places, stop)


def parse(page: str) -> tuple[Node, int]:
    """The tree of a page, whatever its markup, and its depth. Time grows with the page's length alone."""
    root = Node("html")
    open_ = _Open(root)
    stack = open_.stack
    at, size = 0, len(page)

    def put_text(text: str) -> None:
        if text:
            if stack[-1].name == "head" and text.strip():
                open_.cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    text_from = 0
    while True:
        mark = page.find("<", at)
        if mark < 0:
            put_text(page[text_from:])
            return root, open_.deepest
        after = page[mark + 1 : mark + 2]
        if after == "!" or after == "?":
            put_text(page[text_from:mark])
            end = page.find("-->", mark + 4) if page.startswith("<!--", mark) and not page.startswith(("<!-->", "<!--->"), mark) else page.find(">", mark)
            if end < 0:
                return root, open_.deepest
            text_from = at = page.index(">", end) + 1
            continue
        closing = after == "/"
        m = _NAME.match(page, mark + 1 + closing)
        if m is None:
            if closing:  # no end tag: a comment
                put_text(page[text_from:mark])
                end = page.find(">", mark)
                if end < 0:
                    return root, open_.deepest
                text_from = at = end + 1
            else:
                at = mark + 1  # plain text
            continue
        put_text(page[text_from:mark])
        attrs, end = _tag(page, m.end())
        if end < 0:  # the page ends within a tag, which so is none
            return root, open_.deepest
        text_from = at = end
        name = m.group().lower()
        if closing:
            _end_tag(name, open_)
            continue
        if name == "html":
            root.attrs = root.attrs or attrs
            continue
        node = _start_tag(name, attrs, open_)
        if node is None:
            continue
        if name in _RAW:
            found = _raw_end(name).search(page, at)
            stop = found.start() if found else size
            inner = page[at:stop]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            if not found:
                return root, open_.deepest
            end = page.find(">", found.end())
            if end < 0:
                return root, open_.deepest
            text_from = at = end + 1
        elif name not in _VOID and not (name in _FOREIGN and page[end - 2] == "/"):
            open_.push(node)


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def _end_tag(name: str, open_: _Open) -> None:
    top = open_.stack[-1]
    own = open_.last((name,))
    if name == "p" and not own:
        top.children.append(Node("p"))
    elif name == "br":
        top.children.append(Node("br"))
    elif own and (name in ("table", "tr", "tbody", "thead", "tfoot", "body") or own >= open_.last(_SCOPES)):
        open_.cut(own)


def _start_tag(name: str, attrs: list[tuple[str, str]], open_: _Open) -> Node | None:
    """The element, put where it belongs; null for a second body."""
    stack = open_.stack
    if stack[-1].name == "head" and name not in _HEAD_ONLY:
        open_.cut(len(stack) - 1)
    if name in _ENDS_P:
        open_.close(("p",), ("td", "th", "table", "button", "caption"))
    if name in _IMPLIED_ENDS:
        open_.close(*_IMPLIED_ENDS[name])
    if name == "body" and open_.last(("body",)):
        return None
    if name in ("td", "th") and stack[-1].name != "tr" and open_.last(("table",)):
        row = Node("tr")  # implied
        stack[-1].children.append(row)
        open_.push(row)
    node = Node(name, attrs or None)
    stack[-1].children.append(node)
    return node


def style_rules(css: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Selectors and the declarations that matter here; what stands in blocks with ``@`` does not count."""
    at = 0
    while (open_ := css.find("{", at)) >= 0:
        selectors = css[at:open_].rpartition(";")[2].strip()
        if selectors.startswith("@"):
            depth, at = 1, open_ + 1
            while depth and at < len(css):
                depth += (css[at] == "{") - (css[at] == "}")
                at += 1
            continue
        end = css.find("}", open_)
        end = len(css) if end < 0 else end
        told = {k.lower(): v.lower() for k, v in _STYLE.findall(css[open_ + 1 : end])}
        if told:
            for selector in selectors.split(","):
                if (m := _SELECTOR.fullmatch(selector.strip())) and m.group():
                    yield (m.group(1) or "").lower() + (m.group(2) or "") + (m.group(3) or ""), told
        at = end + 1


def apply_styles(root: Node) -> None:
    """Give every element the declarations that count for it: of style sheets by tag, class and identifier, then its own."""
    nodes, sheets, work = [], [], [root]
    while work:
        node = work.pop()
        if node.name == "style":
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        elif node.attrs or node.name not in _RAW:
            nodes.append(node)
            work += [c for c in reversed(node.children) if isinstance(c, Node)]
    rules: dict[str, dict[str, str]] = {}
    for sheet in sheets:
        for selector, told in style_rules(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
            rules[selector] = rules.get(selector, {}) | told
    for node in nodes:
        style = dict(rules.get(node.name, ())) if rules else {}
        attrs = node.attributes()
        if rules and attrs:
            for mark, names in ((".", attrs.get("class", "").split()), ("#", [attrs["id"]] if "id" in attrs else [])):
                for name in names:
                    style |= rules.get(mark + name, {}) | rules.get(node.name + mark + name, {})
        if "style" in attrs:
            style |= {k.lower(): v.lower() for k, v in _STYLE.findall(attrs["style"])}
        node.style = style


def shown(node: Node, hidden: bool) -> bool | None:
    """Whether an element's own text is hidden (False: it shows); null if the element shows nothing, its children included.

    ``hidden``: whether its parent's text is. Hidden children of ``visibility`` take room no
    text can show, but their own children may be visible again.
    """
    if node.name in _UNSEEN:
        return None
    if not node.attrs and not node.style:
        return None if node.name == "dialog" else hidden
    attrs, style = node.attributes(), node.style
    if style.get("display") == "none" or "hidden" in attrs and "display" not in style or node.name == "dialog" and "open" not in attrs:
        return None
    told = style.get("visibility")
    return hidden if told is None or told == "inherit" else told in ("hidden", "collapse")


@cache
def _wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


def columns_of(text: str) -> int:
    """How many columns a text takes."""
    return len(text) if text.isascii() else len(text) + sum(map(_wide, text))


class Layout:
    """Text under way: finished lines, the line being written, and the blank line owed before the next.

    Blocks within blocks write to the same layout; what they add is an indentation, and list
    items a mark that stands before their first line.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.owed = False
        self.space = False  # a collapsed space waits for the next word
        self.indent = 0
        self.marks: list[str] = []  # of items without a line yet
        self.first = 0  # lines before the innermost block

    def words(self, text: str) -> None:
        flat = _WHITE.sub(" ", text)
        if flat[:1] == " ":
            self.space = True
            flat = flat[1:]
        if flat:
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = flat[-1] == " "
            self.parts.append(flat[:-1] if self.space else flat)

    def end(self) -> None:
        """End the line, if one is under way."""
        if self.parts:
            self.line("".join(self.parts))
            self.parts = []
        self.space = False

    def line(self, text: str) -> None:
        if self.owed and self.lines:
            self.lines.append("")
        self.owed = False
        mark = "".join(self.marks)
        before = min(self.indent - len(mark), INDENT)
        self.lines.append(" " * before + mark + text if text or mark else "")
        self.marks.clear()

    def gap(self) -> None:
        self.end()
        if len(self.lines) > self.first:
            self.owed = True

    def enter(self, spaced: bool, indent: int = 0, mark: str = "") -> tuple:
        """Begin a block; what it returns ends it."""
        self.end()
        had = self.owed, self.first, len(self.lines), spaced, indent + len(mark), len(self.marks), mark
        if spaced and len(self.lines) > self.first:
            self.owed = True
        self.first = len(self.lines)
        self.indent += indent + len(mark)
        if mark:
            self.marks.append(mark)
        return had

    def leave(self, had: tuple) -> None:
        self.end()
        owed, self.first, lines, spaced, indent, marks, mark = had
        self.indent -= indent
        if len(self.lines) > lines:
            self.owed = spaced
        else:  # nothing was shown
            self.owed = owed
            del self.marks[marks:]


def lines_of(children: list, hidden: bool = False, tables: int = 0) -> list[str]:
    out = Layout()
    for child in children:
        write(child, out, hidden, None, tables)
    out.end()
    return out.lines


def _raw_lines(out: Layout, text: str) -> None:
    if text.strip("\n"):
        for x in text.removeprefix("\n").rstrip("\n").split("\n"):
            out.line(x)


def write(node, out: Layout, hidden: bool = False, marks: _Numbers | bool | None = None, tables: int = 0) -> None:
    """``marks``: the numbers of an ordered list, or False inside a list or its items; ``tables``: how many stand around."""
    if isinstance(node, str):
        if not hidden:
            out.words(node)
        return
    name = node.name
    hidden = shown(node, hidden)
    if hidden is None:
        return
    if node.style.get("white-space", "")[:4] == "pre" and node.style["white-space"] != "pre-line" and name in _BLOCK and name not in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol", "menu", "dir", "dl"):
        had = out.enter(name in _SPACED)
        _raw_lines(out, _raw_text(node, hidden).replace("\r\n", "\n"))
        out.leave(had)
    elif name == "br":
        out.line("".join(out.parts))
        out.parts, out.space = [], False
    elif name == "input":
        attrs = node.attributes()
        if attrs.get("type", "").lower() in ("button", "submit", "reset") and not hidden and attrs.get("value"):
            out.space = True
            out.words(attrs["value"])
            out.space = True
    elif name in ("wbr", "img", "col", "colgroup"):
        return
    elif name == "hr":
        out.gap()
    elif name in ("ul", "ol", "menu", "dir"):
        attrs = node.attributes()
        start = int(attrs["start"]) if re.fullmatch(r"-?[0-9]{1,9}", attrs.get("start", "")) else 1
        had = out.enter(marks is None)
        numbers = _Numbers(start) if name == "ol" else False
        for child in node.children:
            write(child, out, hidden, numbers, tables)
        out.leave(had)
    elif name == "li":
        told = node.attributes().get("value", "")
        if isinstance(marks, _Numbers) and re.fullmatch(r"-?[0-9]{1,9}", told):
            marks.next = int(told)
        had = out.enter(False, mark=f"{marks.take()}. " if isinstance(marks, _Numbers) else "- ")
        for child in node.children:
            write(child, out, hidden, False, tables)
        out.leave(had)
    elif name in ("dd", "blockquote"):
        had = out.enter(name == "blockquote", 4)
        for child in node.children:
            write(child, out, hidden, None, tables)
        out.leave(had)
    elif name in ("pre", "xmp"):
        had = out.enter(True)
        _raw_lines(out, _raw_text(node, hidden).replace("\r\n", "\n"))
        out.leave(had)
    elif name == "textarea":  # its lines as they stand, a box of its own in the line
        out.space = True
        for i, line in enumerate(_raw_text(node, hidden).replace("\r\n", "\n").removeprefix("\n").split("\n")):
            if i:
                out.end()
            out.words(line)
        out.space = True
    elif name == "select":
        out.space = True
        for option in _chosen(node):
            write(option, out, hidden, None, tables)
            out.space = True
    elif name == "table" and tables < NESTED:
        had = out.enter(True)
        for x in table_lines(node, hidden, tables + 1):
            out.line(x)
        out.leave(had)
    elif name in _BLOCK:
        closed = name == "details" and "open" not in node.attributes()
        if name in _SPACED:
            out.gap()
        else:
            out.end()
        for child in _summary(node) if closed else node.children:
            write(child, out, hidden, None, tables)
        if name in _SPACED:
            out.gap()
        else:
            out.end()
    else:
        if name in ("td", "th"):  # a cell outside a table
            out.space = True
        if name == "q" and not hidden:
            out.words('"')
        for child in node.children:
            write(child, out, hidden, marks, tables)
        if name == "q" and not hidden:
            out.words('"')
            out.space = False


class _Numbers:
    """The numbers of an ordered list."""

    def __init__(self, start: int):
        self.next = start

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def _summary(details: Node) -> list:
    """What closed details show: their first summary."""
    return [c for c in details.children if isinstance(c, Node) and c.name == "summary"][:1]


def _chosen(select: Node) -> list[Node]:
    """The options that a closed list shows: those selected, else the first; all of a list of many."""
    options, work = [], list(reversed(select.children))
    while work:
        child = work.pop()
        if isinstance(child, Node):
            if child.name == "option":
                options.append(child)
            elif child.name == "optgroup":
                work += reversed(child.children)
    if "multiple" in select.attributes():
        return options
    chosen = [o for o in options if "selected" in o.attributes()]
    return chosen[-1:] or options[:1]


def _raw_text(node: Node, hidden: bool) -> str:
    out, work = [], [(child, hidden) for child in reversed(node.children)]
    while work:
        child, hidden = work.pop()
        if isinstance(child, str):
            if not hidden:
                out.append(child)
        elif child.name == "br":
            out.append("\n")
        elif (own := shown(child, hidden)) is not None:
            work += [(c, own) for c in reversed(child.children)]
    return "".join(out)


class _Taken:
    """Columns that cells of rows above still hold, as runs of columns with the row at which they end."""

    def __init__(self):
        self.runs = np.zeros((0, 3), np.int64)  # begin, end, row

    def free(self, row: int) -> list[tuple[int, int]]:
        """The runs that hold columns in this row, joined, in order."""
        if not len(self.runs):
            return []
        if (self.runs[:, 2] <= row).any():
            self.runs = self.runs[self.runs[:, 2] > row]
            if not len(self.runs):
                return []
        reach = np.maximum.accumulate(self.runs[:, 1])
        new = np.flatnonzero(np.concatenate(([True], self.runs[1:, 0] > reach[:-1])))
        return list(zip(self.runs[new, 0].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist()))

    def hold(self, cells: list[tuple[int, int, int]]) -> None:
        merged: list[list[int]] = []
        for begin, end, row in cells:
            if merged and merged[-1][1] == begin and merged[-1][2] == row:
                merged[-1][1] = end
            else:
                merged.append([begin, end, row])
        if merged:
            runs = np.concatenate((self.runs, np.array(merged, np.int64)))
            self.runs = runs[np.argsort(runs[:, 0], kind="stable")]


def table_lines(node: Node, hidden: bool = False, tables: int = 1) -> list[str]:
    """Captions, then the rows (those of ``tfoot`` last) with each column as wide as its widest cell and two spaces between columns.

    A cell of several rows holds its columns in the rows below it, where nothing stands.
    """
    before: list[str] = []
    bodies: list[list] = [[]]  # rows of each part of the table
    last: list[list] = []  # of tfoot
    number, taken = 0, _Taken()

    def add_row(row: Node, hidden: bool, rows: list) -> None:
        nonlocal number
        at, placed, held = 0, [], []
        cells = [c for c in row.children if isinstance(c, Node) and c.name in ("td", "th")]
        busy = iter(taken.free(number) if cells else ())
        run = next(busy, None)
        for cell in row.children:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    before.extend(lines_of([cell], hidden, tables))
                continue
            own = shown(cell, hidden)
            if own is None:
                continue
            while run and run[0] <= at:
                at = max(at, run[1])
                run = next(busy, None)
            attrs = cell.attributes()
            across, down = _span(attrs, "colspan", 1000), _span(attrs, "rowspan", 65534)
            placed.append((at, lines_of(cell.children, own, tables), across))
            if down != 1:
                held.append((at, at + across, number + (down or 1 << 40)))
            at += across
        rows.append(placed)
        taken.hold(held)
        number += 1

    def gather(parent: Node, hidden: bool, rows: list) -> None:
        for child in parent.children:
            if isinstance(child, str):
                if child.strip():
                    before.extend(lines_of([child], hidden, tables))
                continue
            own = shown(child, hidden)
            if own is None:
                continue
            if child.name == "caption":
                before.extend(lines_of(child.children, own, tables))
            elif child.name in ("tbody", "thead", "tfoot"):
                taken.runs = taken.runs[:0]
                part: list = []
                gather(child, own, part)
                (last if child.name == "tfoot" else bodies).append(part)
                if child.name != "tfoot":
                    bodies.append([])
                taken.runs = taken.runs[:0]
            elif child.name == "tr":
                add_row(child, own, bodies[-1] if parent is node else rows)
            elif child.name not in ("col", "colgroup"):
                before.extend(lines_of([child], hidden, tables))

    gather(node, hidden, bodies[0])
    rows = [row for part in [*bodies, *last] for row in part]
    sized = [[(at, [(x, columns_of(x)) for x in cell], span) for at, cell, span in row] for row in rows]
    widths: dict[int, int] = {}
    for row in sized:
        for at, cell, span in row:
            widths[at] = max(widths.get(at, 0), max((n for _, n in cell), default=0) if span == 1 else 0)
    left, total = {}, 0  # where each column that a cell begins in stands
    for c in sorted(widths):
        left[c] = min(total, PAD)
        total += widths[c] + 2
    out = []
    for row in sized:
        open_ = [(i, at, cell) for i, (at, cell, _) in enumerate(row) if cell]
        line = 0
        while open_:  # the cells that still have lines
            parts, length = [], 0
            for _, at, cell in open_:
                text, n = cell[line]
                if text:
                    pad = max(left[at] - length, 2 if parts else 0)
                    parts.append(" " * pad + text)
                    length += pad + n
            out.append("".join(parts).rstrip())
            line += 1
            open_ = [c for c in open_ if line < len(c[2])]
    return before + out


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    """Columns or rows of a cell; 0 rows are all that follow."""
    told = attrs.get(name, "1")
    n = int(told) if re.fullmatch(r"[0-9]{1,9}", told) else 1
    return min(n if name == "rowspan" else max(n, 1), most)


def page_text(page: str | None) -> str:
    """All visible text of a page; null and empty pages have none."""
    if not page:
        return ""
    root, depth = parse(page)
    apply_styles(root)
    if 4 * depth + 500 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * depth + 500)
    return "\n".join(x.rstrip() for x in lines_of(root.children)).strip("\n")


def extract(pages: DataFrame, page: str = "html", key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: the key and ``text``. Null and empty pages give an empty text.

    Null or repeated keys are rows like any other, and other columns are not read. One
    pass, no shuffle; a page is held by itself.
    """
    ship(pages.sparkSession)
    named = pages.select(pages[quoted(key)].alias("key"), pages[quoted(page)].alias("page"))
    kind = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([page_text(p.as_py()) for p in part.column("page")], pa.string())], ["key", "text"])

    return named.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
