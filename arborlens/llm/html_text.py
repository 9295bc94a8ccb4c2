"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer and a tree builder with implied tags make a tree: a block ends an open paragraph, list items, cells, rows and
options end their like, end tags without a start are ignored. Content that is not shown is left out: scripts, styles, the
head, templates, comments, fallback content of media, closed dialogs, and elements with ``hidden``, ``display:none`` or
``visibility:hidden``. Style sheets are not read.

The places of open tags are kept by name, so that the work per tag does not grow with the depth, and the tree is rendered in one
walk without recursion: deep nesting is harmless. Lines are indented for at most ``LEVELS`` lists and quotes around them, and
tables within ``NESTED`` tables flow like other blocks, as each level would lay out all inner ones again. Blocks start a line, paragraphs,
headings, lists and tables are set off by an empty line; ``br`` breaks a line, ``pre`` keeps its blanks; list items get their
mark or number and their lines are indented; cells of a table stand below each other, two blanks apart, column and row
spans included. A cell wider than ``WIDEST`` does not widen its column. Numbers in attributes beyond 32 bits count as absent.

Defined results: null and empty pages give an empty text; unfinished tags and comments reach to the end; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 60
LEVELS = 64
NESTED = 16

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist rp".split())
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul""".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
BLOCKS = ENDS_P | frozenset("html body li dt dd tr caption legend option optgroup title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr".split())
HEAD_CONTENT = frozenset("base link meta title style script template noscript".split())
SCOPE = frozenset("html table td th caption button object template".split())
_LAID_OUT = BLOCKS | frozenset("br menu td th textarea".split())
_P, _TABLE, _ROWS = {"p"}, frozenset({"table"}), frozenset("tr tbody thead tfoot".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_MAYBE_HIDDEN = re.compile("hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?")
_NOT_DISPLAYED = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_NUMBER = {name: re.compile(rf"\b{name}\s*=\s*[\"']?\s*(-?\d+)", re.I) for name in ("colspan", "rowspan", "start", "value")}
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def number(self, name: str, default: int) -> int:
        found = _NUMBER[name].search(self.attributes) if self.attributes else None
        return int(found[1]) if found and len(found[1]) < 12 and -2**31 <= int(found[1]) < 2**31 else default


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and values."""
    for found in _ATTRIBUTE.finditer(text):
        yield found[1].lower(), found[2] or found[3] or found[4] or ""


def _hidden(attributes: str) -> bool:
    """Whether there is an attribute ``hidden``, or a style that hides; of repeated attributes the first counts."""
    if not _MAYBE_HIDDEN.search(attributes) and "&" not in attributes:
        return False
    seen = set()
    for name, value in _attributes(attributes):
        if name == "hidden":
            return True
        if name == "style" and name not in seen and _NOT_DISPLAYED.search(unescape(value)):
            return True
        seen.add(name)
    return False


class Open:
    """The open elements from the root down, and where those of each name lie."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, low: int) -> None:
        for node in self.stack[low:]:
            self.places[node.tag].pop()
        del self.stack[low:]

    def last(self, tags) -> int:
        """Place of the innermost of the tags; 0 if none is open."""
        deepest = 0
        for tag in tags:
            places = self.places[tag]
            if places and places[-1] > deepest:
                deepest = places[-1]
        return deepest

    def close(self, tags: set[str], limit) -> None:
        """End the outermost of the open ``tags`` above the innermost of ``limit``, as far as they follow each other."""
        low = self.last(tags)
        if low > self.last(limit):
            while low > 1 and self.stack[low - 1].tag in tags:
                low -= 1
            self.cut(low)

    def end(self, tag: str) -> None:
        """End tag: the innermost of its name, if no guard lies within it."""
        places = self.places.get(tag)
        if places:
            guard = _TABLE if tag in _ROWS else SCOPE if tag not in SCOPE else _TABLE - {tag}
            if places[-1] > self.last(guard):
                self.cut(places[-1])


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    opened = Open(root)
    stack, places, search, at = opened.stack, opened.places, _TOKEN.search, 0

    def text(start: int, end: int) -> None:
        piece = page[start:end]
        if stack[-1].tag == "head" and not piece.isspace():
            opened.cut(len(stack) - 1)
        stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    while True:
        found = search(page, at)
        if not found:
            if at < len(page):
                text(at, len(page))
            return root
        start, end = found.span()
        if at < start:
            text(at, start)
        at = end
        ends, name, attributes = found.group(1, 2, 3)
        if not name:
            ends, name, attributes = found.group(4, 5, 6)  # with a quote that is not closed
            if not name:
                continue
        tag = name.lower()
        if ends:
            if stack[-1].tag == tag and len(stack) > 1:  # the usual case
                if tag != "body":
                    stack.pop()
                    places[tag].pop()
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                opened.end(tag)
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            opened.cut(len(stack) - 1)
        if tag in ENDS_P and places["p"]:
            opened.close(_P, SCOPE)
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                opened.push(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes and attributes.endswith("/") and tag in ("svg", "path", "use", "circle", "rect", "line"):
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            stop, at = shut.span() if shut else (len(page), len(page))
            if tag == "textarea" and at > stop:
                node.children.append(unescape(page[end:stop]))
            continue
        places[tag].append(len(stack))
        stack.append(node)


_NONE = 1 << 60


class Page:
    """Lines being laid out; an indentation may come with a mark for its first line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indents: list[str] = []
        self.marks: list[str | None] = []
        self.unwritten = _NONE  # the outermost level whose mark is not written
        self.gap = False
        self.wants_blank = False

    def indent(self, by: str, mark: str | None = None) -> None:
        if mark is not None:
            self.unwritten = min(self.unwritten, len(self.indents))
        self.indents.append(by)
        self.marks.append(mark)

    def outdent(self) -> None:
        self.indents.pop()
        self.marks.pop()
        if self.unwritten >= len(self.indents):
            self.unwritten = _NONE

    def _lead(self) -> str:
        """Indentation of a new line, with the marks that no line has had yet."""
        if self.unwritten == _NONE:
            return "".join(self.indents[:LEVELS])
        out = self.indents[:min(self.unwritten, LEVELS)]
        for i in range(self.unwritten, len(self.indents)):
            if self.marks[i] is not None:
                out.append(self.marks[i])
            elif i < LEVELS:
                out.append(self.indents[i])
            self.marks[i] = None
        self.unwritten = _NONE
        return "".join(out)

    def _write(self, piece: str) -> None:
        if not self.line:
            if self.wants_blank and self.lines:
                self.lines.append("")
            self.wants_blank = False
            self.line.append(self._lead())
        elif self.gap:
            self.line.append(" ")
        self.gap = False
        self.line.append(piece)

    def flow(self, piece: str) -> None:
        odd = "\n" in piece or "  " in piece or "\t" in piece or "\r" in piece or "\f" in piece
        words = _BLANKS.sub(" ", piece) if odd else piece
        if words.startswith(" "):
            self.gap = True
        core = words.strip(" ")
        if core:
            self._write(core)
            self.gap = words.endswith(" ")

    def keep(self, piece: str) -> None:
        for i, row in enumerate(piece.split("\n")):
            if i:
                self.end(force=True)
            if row:
                self._write(row)

    def end(self, blank: bool = False, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif force:
            self.lines.append("")
        self.gap = False
        self.wants_blank |= blank

    def block(self, rows: list[str]) -> None:
        for row in rows:
            self._write(row)
            self.end()

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Aligned lines of rows of cells ``(text, columns, rows)``."""
    grid: list[list[list[str]]] = []
    hanging: dict[int, int] = {}  # column: rows that a cell from above still takes
    for row in rows:
        out: list[list[str]] = []
        taken, hanging = hanging, {c: n - 1 for c, n in hanging.items() if n > 1}
        for text, wide, high in row:
            while len(out) in taken:
                out.append([])
            for k in range(wide):
                if high > 1:
                    hanging[len(out)] = high - 1
                out.append(text.split("\n") if not k else [])
        grid.append(out)
    widths = [0] * max(map(len, grid), default=0)
    for row in grid:
        for c, cell in enumerate(row):
            widths[c] = max([widths[c], *(len(x) for x in cell if len(x) <= WIDEST)])
    lines = []
    for row in grid:
        for i in range(max(map(len, row), default=0)):
            parts = [(cell[i] if i < len(cell) else "").ljust(widths[c]) for c, cell in enumerate(row)]
            lines.append("  ".join(p for c, p in enumerate(parts) if widths[c] or p).rstrip(" "))
    return [x for x in lines if x]


def render(root: Node) -> str:
    """The visible text of a tree."""
    pages, tables = [Page()], []  # tables: rows of the tables being laid out; null for those that flow
    counters: list[int | None] = []
    pre = 0
    work: list[tuple[Node | str, bool]] = [(root, True)]
    while work:
        node, enter = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            page.keep(node) if pre else page.flow(node)
            continue
        tag = node.tag
        if enter:
            if tag in UNSEEN or node.attributes and _hidden(node.attributes):
                continue
            if tag not in _LAID_OUT:
                work.extend([(child, True) for child in reversed(node.children)])
                continue
            if tag == "dialog" and not any(name == "open" for name, _ in _attributes(node.attributes)):
                continue
            if tag == "br":
                page.end(force=True)
                continue
            if tag in BLOCKS:
                page.end(blank=tag in SPACED and not (tag in ("ul", "ol", "menu") and counters))
            if tag in ("ul", "ol", "menu"):
                counters.append(node.number("start", 1) if tag == "ol" else None)
            elif tag == "li":
                count = counters[-1] if counters else None
                if count is not None:
                    count = node.number("value", count)
                    counters[-1] = count + 1
                mark = "- " if count is None else f"{count}. "
                page.indent(" " * len(mark), mark)
            elif tag in ("blockquote", "dd"):
                page.indent("  ")
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([] if len(tables) < NESTED else None)
            elif tag == "tr" and tables:
                if tables[-1] is None:
                    page.end()
                else:
                    tables[-1].append([])
            elif tag in ("td", "th", "caption"):
                if tables and tables[-1] is not None and (tag == "caption" or tables[-1]):
                    pages.append(Page())
                else:
                    page.flow(" ")
            work.append((node, False))
            work.extend((child, True) for child in reversed(node.children))
            continue
        if tag in ("td", "th", "caption") and len(pages) > 1 and tables and tables[-1] is not None and (tag == "caption" or tables[-1]):
            cell = pages.pop().text()
            if tag == "caption":
                pages[-1].block(cell.split("\n") if cell else [])
            else:
                tables[-1][-1].append((cell, min(max(node.number("colspan", 1), 1), 1000), min(max(node.number("rowspan", 1), 1), 65534)))
            continue
        if tag == "table":
            page.block(_table(tables.pop() or []))
        elif tag in ("ul", "ol", "menu"):
            counters.pop()
        elif tag in ("li", "blockquote", "dd") and page.indents:
            page.end()
            page.outdent()
        elif tag in ("pre", "textarea"):
            pre -= 1
        if tag in BLOCKS:
            page.end(blank=tag in SPACED and not (tag in ("ul", "ol", "menu") and counters))
    return pages[0].text()


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([visible_text(p) for p in batch.column(2).to_pylist()], pa.string())],
            names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _extract, "page_id bigint, url string, text string")
