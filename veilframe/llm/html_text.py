"""Layout-aware text of HTML pages.

A tree builder takes the tags of a page, adds the tags that HTML implies (a paragraph
ends where a block begins, a list item where the next begins, cells, rows and table
sections end one another, head and body appear by themselves) and closes what is open
at an end tag. As in browsers, elements deeper than MAX_DEPTH become siblings at that depth, so
tables nest a bounded number of times. The renderer emits what a browser without network and with
scripts would draw: elements that are not shown (script, style, template, head, hidden and
display:none ones and the like) give nothing; visibility:hidden is inherited and hides text until
visibility:visible; of SVG the text elements count, of form fields the value (or placeholder), of
objects the fallback; text that only screen readers skip (aria-hidden) is drawn. Blocks
stand on lines of their own, paragraphs and headings with a blank line between; list
items get a bullet or their number and are indented by their depth; the cells of a table
are padded to the width of their column; preformatted text keeps its white space.
All other visible text is emitted: this is no boilerplate remover.

Defined results: null and empty html give an empty text; broken markup never fails; a
page of any length takes time and memory in proportion to it; repeated rows give
equal results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh, in_arrow, table

# The elements of HTML by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript head title desc metadata defs symbol meta link iframe canvas audio video datalist noembed noframes annotation annotation-xml".split())
FIELDS = frozenset("text search email url tel number date time month week datetime-local submit reset button".split())
LABELS = {"submit": "Submit", "reset": "Reset"}
#: Deeper elements become siblings at this depth.
MAX_DEPTH = 512
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: A start tag ends open elements of the second kind, looked for no higher than the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", regex.S)
ATTR = regex.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = regex.compile(r"(?:^|;)\s*display\s*:\s*none", regex.I)
VISIBILITY = regex.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", regex.I)
SPACE = regex.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "items", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.items = tag, attrs or {}, []


def build(html: str) -> Node:
    """Tree of a page; strings are text, entities resolved."""
    root = Node("html")
    stack = [root]
    counts: dict[str, int] = {}  # open elements by tag

    def push(node: Node) -> None:
        stack[-1].items.append(node)
        stack.append(node)
        counts[node.tag] = counts.get(node.tag, 0) + 1

    def close(n: int) -> None:
        for node in stack[n:]:
            counts[node.tag] -= 1
        del stack[n:]

    def end_p() -> None:
        if counts.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    return close(i)
                if stack[i].tag in ("table", "td", "th", "caption", "button", "object"):
                    return None
        return None

    def imply(tag: str) -> None:
        """Ends and begins what the start tag of tag implies."""
        if counts.get("head") and tag not in HEAD_ONLY and tag != "head":
            close(next(i for i, n in enumerate(stack) if n.tag == "head"))
        if tag in ENDS_P:
            end_p()
        ends, scope = IMPLIED_ENDS.get(tag, ((), ()))
        if any(counts.get(t) for t in ends):
            last = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends:
                    last = i
            if last is not None:
                close(last)
        if tag in ("td", "th") and counts.get("table") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr"))

    at = 0
    while at < len(html):
        lt = html.find("<", at)
        m = TOKEN.match(html, lt) if lt >= 0 else None
        if m is None:  # text, or a lone <
            stop = len(html) if lt < 0 else lt if lt > at else lt + 1
            stack[-1].items.append(unescape(html[at:stop]))
            at = stop
            continue
        if lt > at:
            text = unescape(html[at:lt])
            if counts.get("head") and text.strip() and stack[-1].tag == "head":
                imply("#text")
            stack[-1].items.append(text)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:  # comment, doctype
            continue
        if m["end"]:
            if tag == "br":
                stack[-1].items.append(Node("br"))
            elif tag == "p" and not counts.get("p"):
                stack[-1].items.append(Node("p"))
            elif tag not in ("html", "body") and counts.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        attrs: dict[str, str] = {}
        for a in ATTR.finditer(m["attrs"] or ""):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if tag in ("html", "body"):  # they exist once; a later one adds attributes only
            root.attrs = attrs | root.attrs
            if tag == "body":
                imply("body")
            continue
        imply(tag)
        if tag in VOID:
            stack[-1].items.append(Node(tag, attrs))
        elif tag in RAW:
            end = regex.compile(rf"</{tag}[\s/>]", regex.I).search(html, at)
            stop = end.start() if end else len(html)
            node = Node(tag, attrs)
            node.items.append(unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop])
            stack[-1].items.append(node)
            at = (html.find(">", stop) + 1 or len(html)) if end else len(html)
        else:
            if len(stack) > MAX_DEPTH:
                close(len(stack) - 1)
            push(Node(tag, attrs))
    return root


def shown(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and HIDING.search(a["style"]))


def visible(node: Node, inherited: bool) -> bool:
    """Whether text of a shown node is drawn."""
    found = VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() == "visible" if found else inherited


def field_text(node: Node) -> str:
    """What a form field shows."""
    kind = node.attrs.get("type", "text").lower()
    if kind not in FIELDS:
        return node.attrs.get("alt", "") if kind == "image" else "" if kind in ("hidden", "password", "checkbox", "radio", "file", "range", "color") else node.attrs.get("value", "")
    return node.attrs.get("value") or (node.attrs.get("placeholder", "") if kind not in ("submit", "reset", "button") else LABELS.get(kind, ""))


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: pending space and blank lines are added before text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent = 0
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.put(first)
            for x in rest:
                self.newline(True)
                self.put(x)
            return
        s = SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = bool(self.line)
        core = s.strip(" ")
        if core:
            self.put((" " if self.space and self.line else "") + core)
            self.space = s.endswith(" ")

    def put(self, s: str) -> None:
        if s:
            if not self.line:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.line.append("  " * self.indent + self.mark)
                self.mark = ""
            self.line.append(s)

    def newline(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif keep:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap |= spaced and bool(self.lines)


def _cells(node: Node, seen: bool) -> tuple[list[list[tuple[Node, bool]]], list[tuple[Node, bool]]]:
    """Rows of cells of a table, nested tables not entered, and its captions, each with whether it is visible."""
    rows, captions, todo = [], [], [(node, seen)]
    while todo:
        n, here = todo.pop()
        for x in reversed(n.items):
            if isinstance(x, Node) and shown(x) and x.tag in ("thead", "tbody", "tfoot", "tr", "caption"):
                todo.append((x, visible(x, here)))
        if n.tag == "tr":
            rows.append([(x, visible(x, here)) for x in n.items if isinstance(x, Node) and x.tag in ("td", "th") and shown(x)])
        elif n.tag == "caption":
            captions.append((n, here))
    return rows, captions


def _stray(node: Node, seen: bool) -> list:
    """What stands in a table outside its cells; browsers show it before the table."""
    out, todo = [], [(node, seen)]
    while todo:
        n, here = todo.pop()
        for x in n.items:
            if isinstance(x, str):
                if x.strip() and here:
                    out.append((x, here))
            elif x.tag in ("thead", "tbody", "tfoot", "tr", "colgroup"):
                if shown(x):
                    todo.append((x, visible(x, here)))
            elif x.tag not in ("caption", "col") and (n.tag != "tr" or x.tag not in ("td", "th")):
                out.append((x, here))
    return out


def render(root: Node, pre: bool = False, seen: bool = True) -> str:
    """All visible text below a node, laid out in lines. Only tables recurse, MAX_DEPTH / 2 deep at most."""
    page = Page()
    lists: list[list] = []  # kind and next number of the open lists
    todo: list = [("open", x, seen, False) for x in reversed(root.items)] if shown(root) else []
    deep = 1 if pre else 0
    while todo:
        what, x, here, drawing = todo.pop()
        if what == "leave":
            tag, undo = x
            page.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
            if undo == "list":
                lists.pop()
                page.indent = max(0, len(lists) - 1)
            elif undo == "quote":
                page.indent -= 1
            elif undo == "pre":
                deep -= 1
            elif undo == "item":
                page.mark = ""
            continue
        if isinstance(x, str):
            if here and not drawing:
                page.text(x, deep > 0)
            continue
        if not shown(x):
            continue
        tag, here = x.tag, visible(x, here)
        if tag == "br":
            page.newline(True)
            continue
        if tag == "hr":
            page.block(True)
            continue
        if tag in ("img", "input"):
            if here:
                label = x.attrs.get("alt", "") if tag == "img" else field_text(x)
                page.text(label if tag == "img" else f" {label} ", False)
            continue
        if tag == "table":
            for y, own in _stray(x, here):
                if isinstance(y, str):
                    page.text(y, False)
                else:
                    page.block(False)
                    page.text(render_one(y, own), True)
            page.block(True)
            rows, captions = _cells(x, here)
            for c, own in captions:
                page.text(render(c, seen=own), True)
                page.newline()
            for line in grid([[render(c, seen=own).split("\n") for c, own in row] for row in rows], [[c for c, _ in row] for row in rows]):
                page.put(line)
                page.newline()
            page.block(True)
            continue
        if tag == "svg":  # of a drawing only text elements and embedded HTML hold text
            todo.extend(("open", y, here, True) for y in reversed(x.items))
            continue
        if drawing and tag in ("text", "foreignobject"):
            page.space = bool(page.line)
            drawing = False
        if tag not in BLOCK:
            if tag == "q" and here:
                page.text('"', False)
                todo.append(("open", '"', here, drawing))
            todo.extend(("open", y, here, drawing) for y in reversed(x.items))
            continue
        page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
        undo = ""
        if tag in ("ul", "ol", "menu", "dir"):
            start = x.attrs.get("start", "1")
            lists.append([tag, int(start) if regex.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            page.indent, undo = len(lists) - 1, "list"
        elif tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            page.mark, undo = (f"{kind[1]}. " if kind[0] == "ol" else "- "), "item"
            kind[1] += 1
        elif tag == "blockquote":
            page.indent, undo = page.indent + 1, "quote"
        elif tag == "pre":
            deep, undo = deep + 1, "pre"
        todo.append(("leave", (tag, undo), here, drawing))
        todo.extend(("open", y, here, drawing) for y in reversed(x.items))
    page.newline()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    start = next((i for i, s in enumerate(page.lines) if s), len(page.lines))
    return "\n".join(page.lines[start:])


def render_one(node: Node, seen: bool) -> str:
    top = Node("div")
    top.items.append(node)
    return render(top, seen=seen)


def grid(cells: list[list[list[str]]], rows: list[list[Node]]) -> list[str]:
    """Lines of a table: columns padded to their widest one-column cell, two spaces apart.

    A cell with rowspan keeps its columns free in the rows below; one with colspan takes
    several. Cells of several lines make rows of several lines.
    """
    span = lambda n, k: min(int(v), 1000) if regex.fullmatch(r"[0-9]{1,6}", v := n.attrs.get(k, "1")) and int(v) else 1
    taken: dict[int, int] = {}  # columns to rows for which they stay taken
    placed: list[list[tuple[int, int, list[str]]]] = []
    widths: dict[int, int] = {}
    for row, nodes in zip(cells, rows, strict=True):
        at, line, now = 0, [], {c: r for c, r in taken.items() if r > 0}
        taken = {c: r - 1 for c, r in now.items() if r > 1}
        for text, node in zip(row, nodes, strict=True):
            while at in now:
                at += 1
            across, down = span(node, "colspan"), span(node, "rowspan")
            line.append((at, across, text))
            if across == 1:
                widths[at] = max(widths.get(at, 0), *(width(s) for s in text))
            for c in range(at, at + across):
                if down > 1:
                    taken[c] = down - 1
            at += across
        placed.append(line)
    starts: dict[int, int] = {}
    last = max((a + n for line in placed for a, n, _ in line), default=0)
    x = 0
    for c in range(last + 1):
        starts[c] = x
        x += widths[c] + 2 if widths.get(c) else 0
    out = []
    for line in placed:
        for k in range(max((len(t) for _, _, t in line), default=0)):
            parts, used = [], 0
            for a, _, t in line:
                s = t[k] if k < len(t) else ""
                if s:
                    pad = max(starts[a] - used, 2 if used else 0)
                    parts.append(" " * pad + s)
                    used += pad + width(s)
            out.append("".join(parts))
    return [s for s in out if s.strip()]


def extract(html: str | None) -> str:
    return render(build(html)) if html else ""


def extracted(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the laid-out text of column html as column name (renamed if taken)."""
    name = fresh(pages, name)[0]
    at = pages.columns.index(html)
    schema = StructType([*pages.schema.fields, *StructType.fromDDL(f"{name} string").fields])
    kind = to_arrow_schema(schema).field(name).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([extract(x.as_py()) for x in batch.column(at)], type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return in_arrow(pages, run, schema)


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
