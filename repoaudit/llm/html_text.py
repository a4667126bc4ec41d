"""Visible text of HTML pages as a reader sees it: blocks, lists and tables keep their layout.

A tree builder reads tags, supplies end tags and rows that HTML lets authors leave out, closes
what stays open, and puts text and elements that stand between the cells of a table in front of
it, as browsers do. Rules of visibility drop what a browser does not show: what has no place, what is
hidden and does not take it back, fallbacks, closed details. A renderer then writes all visible text: blocks on lines of their own, paragraphs and headings apart by an empty line,
list items with a mark or number and indented by depth, cells of a table aligned in columns with regard
to their spans, preformatted text as it is, other white space collapsed.

Pages are independent and read in Arrow batches; memory follows the largest page. Depth is
bounded by walking without recursion. Null and empty pages give an empty text; broken markup
gives the text that can be read. Repeated rows give equal texts; an empty table an empty one;
columns other than key and page are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What shows none of its contents: scripts, fallbacks of what is played or drawn, notes in drawings.
HIDDEN = frozenset(
    "head script style template noscript title datalist iframe object video audio canvas"
    " desc metadata defs symbol annotation annotation-xml".split()
)
#: Blocks that stand alone, and those that an empty line sets apart.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol"
    " option p pre section summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: What a start tag ends, and the ancestors beyond which it does not look.
_PARTS = frozenset(("table", "tbody", "thead", "tfoot"))
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, _PARTS),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of a table, and the open elements that may hold them besides the table itself.
_SECTIONS = _PARTS - {"table"}
HOLDERS = {
    "tr": _SECTIONS,
    "td": _SECTIONS | {"tr"},
    "th": _SECTIONS | {"tr"},
    "tbody": frozenset(),
    "thead": frozenset(),
    "tfoot": frozenset(),
    "caption": frozenset(),
    "colgroup": frozenset(),
    "col": frozenset(("colgroup",)),
}
#: Where a table can hold no text, what may stand there all the same, and what hides its parts.
_BARE = _PARTS | {"tr", "colgroup"}
_ANYWHERE = frozenset("form noscript script style template".split())
_OPAQUE = frozenset("iframe noscript template".split())
#: Blocks that end an open paragraph.
_ENDS_P = BLOCKS - frozenset("body dd dt html li option tbody td tfoot th thead tr caption".split())
_FENCES = frozenset("td th caption button object table html".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!important\s*)?(?=;|$)", re.I)
#: Largest spans of a cell, as browsers limit them.
COLSPAN, ROWSPAN = 1000, 65_534
#: Widest cell that takes part in aligning a column.
ALIGN = 40


class Node:
    __slots__ = ("tag", "children", "attrs")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder(HTMLParser):
    """A tree of elements and texts, with implied ends.

    ``open`` holds the open elements and ``places`` where those of each tag are in it, so that
    a look for the nearest one costs the same at any depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        """Close the open elements from this one on."""
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def _nearest(self, tags) -> int:
        """The place of the innermost open element of ``tags``, or 0."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=0)

    def _close(self, tags, fences) -> None:
        """Close the innermost open element of ``tags`` unless a fence is nearer."""
        at = self._nearest(tags)
        if at and at >= self._nearest(fences):
            self._cut(at)

    def _table(self, ends=_OPAQUE) -> int:
        """Where the innermost table is among the open elements; 0 if there is none, -1 if one
        of ``ends`` is nearer."""
        at, end = self._nearest(("table",)), self._nearest(ends)
        return at if at > end else -1 if end else 0

    def _insert(self, node) -> None:
        """Add to the innermost open element; what a table cannot hold goes in front of it."""
        at = self._table() if self.open[-1].tag in _BARE else 0
        if at <= 0:
            self.open[-1].children.append(node)
            return
        siblings = self.open[at - 1].children
        before = len(siblings) - 1
        while siblings[before] is not self.open[at]:
            before -= 1
        siblings.insert(before, node)

    def _start_part(self, tag, table: int) -> None:
        """Close what is open in the table up to what may hold ``tag``; a cell gets a row."""
        end = len(self.open) - 1
        while end > table and self.open[end].tag not in HOLDERS[tag]:
            end -= 1
        self._cut(end + 1)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr")
            self.open[-1].children.append(row)
            self._push(row)

    def handle_starttag(self, tag, attrs):
        table = self._table() if tag in HOLDERS else 0
        if table > 0:
            self._start_part(tag, table)
        elif tag == "table":  # outside of cells it ends the table before it
            outer = self._table(_OPAQUE | {"td", "th", "caption"})
            if outer > 0:
                self._cut(outer)
        elif tag in ENDS and table == 0:
            tags, fences = ENDS[tag]
            depth = 0
            while depth != len(self.open):  # a row ends its cell, then the row before it
                depth = len(self.open)
                self._close(tags, fences)
        if tag in _ENDS_P:
            self._close({"p"}, _FENCES)
        node = Node(tag, dict(attrs))
        bare = self.open[-1].tag in _BARE and self._table() > 0
        if tag in HOLDERS or tag in _ANYWHERE:
            self.open[-1].children.append(node)
        else:
            self._insert(node)
        if tag not in VOID and not (tag == "form" and bare):  # a form in a table holds nothing
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        # The slash means nothing but on void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self._insert(Node("br"))
        elif tag == "p" and not self.places.get("p"):
            self._insert(Node("p"))
        elif tag not in VOID:
            fences = () if tag in ("table", "html", "body") else ("table",)
            self._close({tag}, fences if tag not in _PARTS else ("html",))

    def handle_data(self, data):
        if _SPACE.fullmatch(data):
            self.open[-1].children.append(data)
        else:
            self._insert(data)


def visible(node: Node) -> bool:
    """Whether a browser would give the element a place."""
    if node.tag in HIDDEN or node.tag == "input":
        return False
    if not node.attrs:
        return node.tag != "dialog"
    if "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not _UNSEEN.search(node.attrs.get("style") or "")


def unseen(node: Node, inherited: bool) -> bool:
    """Whether texts of the element are hidden, which it inherits unless it says otherwise."""
    found = _VISIBILITY.findall(node.attrs.get("style") or "")
    return found[-1].lower() != "visible" if found else inherited


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in text)
    return len(text) + wide - sum(unicodedata.combining(c) != 0 for c in text)


class Lines:
    """Text under construction: words join on a line, blocks begin lines of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []  # pieces of the line under construction, none of them empty
        self.gap = 0  # empty lines due before the next text

    def words(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        self.add(text if self.line and not self.line[-1].endswith(" ") else text.lstrip(" "))

    def add(self, text: str) -> None:
        if text:
            self.line.append(text)

    def end_line(self, empty: int = 0) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if text:
            self.put(text)
        self.gap = max(self.gap, empty)

    def put(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(text)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _rows(table: Node) -> list[list[Node]]:
    """The rows of a table as lists of cells, head first and foot last."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    stack = [(c, "tbody") for c in reversed(table.children)]
    while stack:
        node, part = stack.pop()
        if isinstance(node, str) or not visible(node):
            continue
        if node.tag == "tr":
            parts[part].append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
        elif node.tag in parts:
            stack += [(c, node.tag) for c in reversed(node.children)]
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def _span(cell: Node, name: str, most: int) -> int:
    text = (cell.attrs.get(name) or "1").strip()
    number = int(text) if re.fullmatch(r"[0-9]{1,9}", text) else 1
    return min(number, most) if number else most if name == "rowspan" else 1


def _places(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """The column of each cell and how many it takes. Cells go to the next column that no cell of a
    row above reaches down into."""
    taken: dict[int, int] = {}  # columns under cells of several rows, and the row that they end before
    out = []
    for r, row in enumerate(rows):
        column, own = 0, []
        for cell in row:
            while taken.get(column, 0) > r:
                column += 1
            across, down = _span(cell, "colspan", COLSPAN), _span(cell, "rowspan", ROWSPAN)
            own.append((column, across))
            if down > 1:
                taken.update(dict.fromkeys(range(column, column + across), r + down))
            column += across
        out.append(own)
    return out


def _table(places: list[list[tuple[int, int]]], rows: list[list[list[str]]]) -> list[str]:
    """Lines of a table, of cells that are lists of lines."""
    widths = {column: 0 for own in places for column, _ in own}
    used = sorted(widths)
    wide = []
    for own, row in zip(places, rows):
        for (column, across), cell in zip(own, row):
            widest = max(map(width, cell), default=0)
            if widest > ALIGN:
                continue
            if across == 1:
                widths[column] = max(widths[column], widest)
            else:
                wide.append((column, across, widest))
    for column, across, widest in wide:  # a cell over several columns widens the first if it has to
        inside = used[bisect_left(used, column) : bisect_left(used, column + across)]
        widths[column] += max(widest - sum(widths[c] for c in inside) - 2 * (len(inside) - 1), 0)
    starts, at = {}, 0
    for column in used:
        starts[column] = at
        at += widths[column] + 2
    out = []
    for own, row in zip(places, rows):
        for k in range(max(map(len, row), default=0)):
            line, done = [], 0
            for (column, _), cell in zip(own, row):
                if k < len(cell) and cell[k]:
                    space = max(starts[column] - done, 2 if done else 0)
                    line += [" " * space, cell[k]]
                    done += space + width(cell[k])
            out.append("".join(line).rstrip())
    return [line for line in out if line]


def render(root: Node) -> list[str]:
    """Lines of text of a tree. A stack of steps replaces recursion, so depth does no harm.

    ``pre`` says that white space counts (1) and that texts are hidden (2).
    """
    top = Lines()
    results: list[list[str]] = []  # lines of finished cells and items
    stack: list[tuple] = [("open", root, top, 0)]
    while stack:
        step, node, out, pre = stack.pop()
        if step == "open" and not isinstance(node, str) and "style" in node.attrs:
            pre = pre & 1 | 2 * unseen(node, bool(pre & 2))
        if step == "end":
            out.end_line(node)
        elif step == "collect":
            results.append(out.done())
        elif step == "table":
            shape = [len(own) for own in node]
            cells = results[len(results) - sum(shape) :] if sum(shape) else []
            del results[len(results) - sum(shape) :]
            each = iter(cells)
            for line in _table(node, [[next(each) for _ in range(n)] for n in shape]):
                out.put(line)
            out.gap = 1
        elif step == "item":
            mark, found = node, results.pop()
            for k, line in enumerate(found):
                out.put((mark if k == 0 else " " * len(mark)) + line if line else "")
        elif isinstance(node, str):
            if pre & 2:
                continue
            if pre:
                first, *more = node.split("\n")
                out.add(first)
                for line in more:
                    text = "".join(out.line)
                    out.line = []
                    out.add(line)
                    out.put(text.rstrip())
            else:
                out.words(node)
        elif not visible(node):
            continue
        elif node.tag == "br":
            had = any(piece.strip() for piece in out.line)
            out.end_line()
            if not had and out.lines:
                out.gap = max(out.gap, 1)
        elif node.tag == "hr":
            out.end_line(1)
        elif node.tag == "img":
            out.words("" if pre & 2 else node.attrs.get("alt") or "")
        elif node.tag == "table":
            out.end_line(1)
            rows = _rows(node)
            stack.append(("table", _places(rows), out, pre))
            for cell in reversed([c for r in rows for c in r]):
                inner, own = Lines(), pre & 1 | 2 * unseen(cell, bool(pre & 2))
                stack.append(("collect", None, inner, pre))
                stack += [("open", c, inner, own) for c in reversed(cell.children)]
            captions = [c for c in node.children if isinstance(c, Node) and c.tag == "caption"]
            for caption in captions:
                stack.append(("end", 0, out, pre))
                stack += [("open", c, out, pre) for c in reversed(caption.children)]
        elif node.tag in ("ul", "ol", "menu"):
            apart = 0 if node.attrs.get("_inner") else 1
            out.end_line(apart)
            stack.append(("end", apart, out, pre))
            number, steps = _start(node), []
            for child in node.children:
                if isinstance(child, Node) and child.tag == "li" and visible(child):
                    mark = f"{number}. " if node.tag == "ol" else "- "
                    number += 1
                    for inner_list in child.children:
                        if isinstance(inner_list, Node) and inner_list.tag in ("ul", "ol", "menu"):
                            inner_list.attrs["_inner"] = "1"
                    inner, own = Lines(), pre & 1 | 2 * unseen(child, bool(pre & 2))
                    steps += [("open", c, inner, own) for c in child.children]
                    steps += [("collect", None, inner, pre), ("item", mark, out, pre)]
                else:
                    steps.append(("open", child, out, pre))
            stack += reversed(steps)
        elif node.tag in BLOCKS:
            apart = 1 if node.tag in APART else 0
            out.end_line(apart)
            stack.append(("end", apart, out, pre))
            children = node.children
            if node.tag == "details" and "open" not in node.attrs:  # shows its summary alone
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack += [("open", c, out, pre | (node.tag == "pre")) for c in reversed(children)]
        else:
            stack += [("open", c, out, pre) for c in reversed(node.children)]
    return top.done()


def _start(node: Node) -> int:
    text = (node.attrs.get("start") or "1").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else 1


def page_text(html: str | None) -> str:
    """The visible text of one page."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return "\n".join(render(builder.root))


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", output: str = "text") -> DataFrame:
    """``(key, output)`` per page."""
    kind = pages.schema[key].dataType.simpleString()

    def extracted(batches):
        for batch in batches:
            texts = [page_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "_text"])

    rows = pages.select(key, html).mapInArrow(extracted, f"_key {kind}, _text string")
    return rows.select(F.col("_key").alias(key), F.col("_text").alias(output))


def html_digest(pages: DataFrame) -> DataFrame:
    """The text of every page with its length."""
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))
