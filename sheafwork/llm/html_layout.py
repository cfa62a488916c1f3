"""Layout-aware HTML rendering: all visible text of a page, with block spacing, lists and aligned table cells.

Tags open and close elements on a stack, with the end tags that HTML implies; an element is laid out when it closes, into
its parent, so depth costs no recursion. Hidden elements (by tag, attribute or style) leave nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from sheafwork.llm.common import pieces

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas datalist".split())
#: In svg and math: what is not drawn; where HTML may stand inside; the start tags that end them elsewhere.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc annotation annotation-xml".split())
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
                     "ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD_TAGS = frozenset("title style script meta link base noscript template".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form "
                           "header hgroup hr html legend li main menu nav optgroup option search section summary".split())
TABLE_PARTS = frozenset("thead tbody tfoot colgroup".split())
#: What a start tag closes: tags to close, and the tags that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, {"table", "td"}),
    **{t: ({"tr", "caption", *TABLE_PARTS}, {"table"}) for t in TABLE_PARTS},
}
#: An end tag does not reach beyond these, unless it names one.
SCOPE = frozenset("td th caption table".split())
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Widest padding of a column; longer cells run over. Widest colspan. Deepest indent; deeper levels are set at it.
WIDEST, MOST_SPAN, DEEPEST = 60, 1000, 20


class Box:
    """Laid out lines and the blank lines wanted around them."""

    __slots__ = ("lines", "margin")

    def __init__(self, lines: list[str], margin: int):
        self.lines, self.margin = lines, margin


class Cell(Box):
    __slots__ = ("columns", "rows")


class Row:
    __slots__ = ("cells",)

    def __init__(self, cells: list[Cell]):
        self.cells = cells


class Element:
    __slots__ = ("tag", "attrs", "items", "hidden", "pre", "count", "foreign", "mute", "veiled")

    def __init__(self, tag: str, attrs: dict, hidden: bool, pre: bool):
        self.tag, self.attrs, self.hidden, self.pre = tag, attrs, hidden, pre
        self.items: list = []
        self.count = 0
        self.foreign = self.mute = False  # of svg or math; an svg element outside its text
        self.veiled = False  # by visibility, which an element inside can set again


def layout(items: list) -> list[str]:
    """Lines of inline pieces (str; None is a line break) and boxes, blank lines between boxes as the larger margin says."""
    if len(items) == 1 and isinstance(items[0], Box):
        return items[0].lines
    lines: list[str] = []
    flow: list = []
    owed = 0

    def put(new: list[str], margin: int) -> None:
        nonlocal owed
        if new:
            if lines:
                lines.extend([""] * max(owed, margin))
            lines.extend(new)
            owed = margin

    def end_flow() -> None:
        if flow:
            put(flow_lines(flow), 0)
            flow.clear()

    for item in items:
        if isinstance(item, Box):
            end_flow()
            put(item.lines, item.margin)
        elif isinstance(item, Row):
            end_flow()
            put(["  ".join(" ".join(c.lines) for c in item.cells)], 0)
        else:
            flow.append(item)
    end_flow()
    return lines


def flow_lines(pieces_: list) -> list[str]:
    text = "".join("\v" if p is None else p for p in pieces_)
    lines = []
    for part in text.split("\v"):
        kept = [SPACES.sub(" ", p) if i % 2 == 0 else p for i, p in enumerate(part.split("\0"))]  # between \0: preformatted
        lines.append("".join(kept).strip(" ") if len(kept) == 1 else "".join(kept).rstrip())
    lines = [x for line in lines for x in line.split("\n")]
    while lines and not lines[-1].strip():
        lines.pop()
    while lines and not lines[0].strip():
        lines.pop(0)
    return lines


def table_lines(items: list) -> list[str]:
    before = layout([i for i in items if not isinstance(i, Row)])
    grid, carried = [], {}
    for row in (i for i in items if isinstance(i, Row)):
        placed, column = {}, 0
        for cell in row.cells:
            while carried.get(column, 0) > 0:
                column += 1
            placed[column] = cell
            for c in range(column, column + cell.columns):
                carried[c] = cell.rows
            column += cell.columns
        carried = {c: n - 1 for c, n in carried.items() if n > 1}
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for c, cell in placed.items():
            if cell.columns == 1:
                widths[c] = max(widths.get(c, 0), *(len(x) for x in cell.lines if len(x) <= WIDEST), 0)
    lines = list(before)
    starts, at = {}, 0
    for c in range(max((c for placed in grid for c in placed), default=-1) + 1):
        starts[c] = at
        at += widths[c] + 2 if c in widths else 0
    for placed in grid:
        for n in range(max((len(c.lines) for c in placed.values()), default=0)):
            line, done = [], 0
            for c in sorted(placed):
                text = placed[c].lines[n] if n < len(placed[c].lines) else ""
                if text:
                    line.append(" " * (max(starts[c], done + 2 if line else 0) - done) + text)
                    done += len(line[-1])
            lines.append("".join(line).rstrip())
    return [x for x in lines if x.strip()]


class Renderer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("#root", {}, False, False)]
        self.open: dict[str, int] = {}

    def push(self, tag: str, attrs: dict) -> None:
        top = self.stack[-1]
        hidden = (top.hidden or tag in UNSEEN or "hidden" in attrs or bool(HIDING.search(attrs.get("style") or "")) or
                  (top.tag == "details" and "open" not in top.attrs and tag != "summary") or (tag == "dialog" and "open" not in attrs))
        el = Element(tag, attrs, hidden, top.pre or tag in ("pre", "textarea"))
        inside = self.in_foreign()
        el.foreign = inside or tag in ("svg", "math")
        el.hidden |= inside and tag in UNDRAWN
        seen = VISIBILITY.findall(attrs.get("style") or "")
        el.veiled = seen[-1].lower() != "visible" if seen else top.veiled
        el.mute = tag == "svg" or (top.mute and not (inside and tag in ("text", "foreignobject")))
        self.stack.append(el)
        self.open[tag] = self.open.get(tag, 0) + 1

    def in_foreign(self) -> bool:
        return self.stack[-1].foreign and self.stack[-1].tag not in POINTS

    def close_within(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Closes the outermost of ``tags`` that no bound separates from the top, with all in it."""
        if not any(self.open.get(t) for t in tags):
            return
        found = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                found = i
            elif tag in bounds:
                break
        while found is not None and len(self.stack) > found:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v for k, v in reversed(attrs)}
        if self.in_foreign():
            if tag not in BREAKOUT and not (tag == "font" and own.keys() & {"color", "face", "size"}):
                if tag == "text":
                    self.stack[-1].items.append(" ")
                self.push(tag, own)
                return
            while self.in_foreign():
                self.pop()
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD_TAGS and tag != "head":
            self.close_within({"head"}, frozenset())
        if tag in BLOCK and self.open.get("p"):
            self.close_within({"p"}, SCOPE | {"button"})
        if tag[0] == "h" and tag[1:].isdigit():
            if self.stack[-1].tag[0] == "h" and self.stack[-1].tag[1:].isdigit():
                self.pop()
        if tag in IMPLIED:
            self.close_within(*IMPLIED[tag])
        if tag in ("td", "th") and self.open.get("table") and self.stack[-1].tag in ("table", *TABLE_PARTS):
            self.push("tr", {})
        if tag == "br":
            self.add(None)
        elif tag == "hr":
            if not self.stack[-1].veiled:
                self.add(Box(["-" * 20], 0))
        elif tag not in VOID:
            self.push(tag, own)
            if tag == "optgroup" and own.get("label") and not self.stack[-1].veiled:
                self.add(Box([own["label"]], 0))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing but the void elements; svg and math do
        if self.stack[-1].foreign and self.stack[-1].tag == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.add(None)
        elif self.open.get(tag) and tag not in ("html", "body"):
            bounds = {"table"} if tag in ("td", "th", "tr", *TABLE_PARTS, "caption") else frozenset() if tag == "table" else SCOPE
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    while len(self.stack) > i:
                        self.pop()
                    break
                if self.stack[i].tag in bounds:
                    break

    def handle_data(self, data: str) -> None:
        if self.open.get("head") and self.stack[-1].tag == "head" and data.strip():
            self.close_within({"head"}, frozenset())
        top = self.stack[-1]
        if not top.hidden and not top.veiled and not top.mute and data:
            data = data.replace("\v", " ").replace("\0", "")
            if top.tag in ("table", "tr", *TABLE_PARTS, "ul", "ol") and not data.strip():
                return
            self.add("\0" + data.replace("\r\n", "\n") + "\0" if top.pre else data)

    def add(self, item) -> None:
        if not self.stack[-1].hidden:
            self.stack[-1].items.append(item)

    def pop(self) -> None:
        el = self.stack.pop()
        self.open[el.tag] -= 1
        if el.hidden:
            return
        parent, tag = self.stack[-1], el.tag
        if tag == "text" and el.foreign:
            el.items.append(" ")
        if tag in ("td", "th"):
            cell = Cell(layout(el.items), 0)
            cell.columns, cell.rows = (min(max(int(v), 1), MOST_SPAN) if (v := (el.attrs.get(k) or "").strip()).isascii() and v.isdigit()
                                       else 1 for k in ("colspan", "rowspan"))
            if parent.tag == "tr":
                parent.items.append(cell)
            else:
                parent.items.append(Box(cell.lines, 0))
        elif tag == "tr":
            others = [i for i in el.items if not isinstance(i, Cell)]
            if others and (lines := layout(others)):
                parent.items.append(Box(lines, 0))
            parent.items.append(Row([i for i in el.items if isinstance(i, Cell)]))
        elif tag == "table":
            parent.items.append(Box(table_lines(el.items), 1))
        elif tag == "li":
            lines = layout(el.items)
            mark = "- "
            if parent.tag == "ol":
                first = (parent.attrs.get("start") or "1").strip()
                parent.count += 1
                mark = f"{(int(first) if first.isascii() and first.isdigit() and len(first) < 10 else 1) + parent.count - 1}. "
            if lines:
                pad = " " * len(mark) if self.open.get("li", 0) < DEEPEST else ""
                parent.items.append(Box([mark + lines[0], *(pad + x if x else x for x in lines[1:])], 0))
        elif tag in ("blockquote", "dd"):
            pad = "  " if self.open.get(tag, 0) < DEEPEST else ""
            parent.items.append(Box([(pad + x).rstrip() for x in layout(el.items)], int(tag in MARGIN)))
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "dl", "menu") and self.open.get("li", 0) > 0
            margin = 0 if nested else max(int(tag in MARGIN), *(i.margin if isinstance(i, Box) else 0 for i in (el.items or [None])[::max(
                len(el.items) - 1, 1)]))  # the margins of the first and last child reach through
            parent.items.append(Box(layout(el.items), margin))
        elif tag in TABLE_PARTS or parent.items:
            parent.items.extend(el.items)
        else:
            parent.items = el.items  # an inline element: its pieces are its parent's

    def text(self, html: str) -> str:
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(layout(self.stack[0].items))


def render(html: str | None) -> str:
    """Visible text of a page; a null or empty page has none."""
    return Renderer().text(html) if html else ""


def render_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, text (visible text), n_chars, n_lines.

    Null and empty pages give an empty text of no lines; text without tags is one block; rows without page_id and
    repeated rows are rendered each. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", limit=1 << 20):
            texts = [render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, text string, n_chars bigint, n_lines bigint")
