"""Markup sources: HTML blocks and tables, XML text, GeoJSON features."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)", re.S)
#: Elements that hold nothing.
EMPTY = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW, HIDDEN = frozenset(("script", "style")), frozenset(("script", "style", "noscript"))
FRAMES = frozenset(("table", "tr"))
KEPT = frozenset("title h1 h2 h3 p li td th tr table".split())


CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def decode_closed(text: str) -> str:
    """Character references that end in a semicolon decoded; one that is cut short stays as it stands."""
    return CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Node:
    """An element of interest: its place in the order of start tags, its text pieces and the rows and cells inside of it."""

    __slots__ = ("name", "order", "first", "last", "hidden", "inside")

    def __init__(self, name: str, order: int, first: int, hidden: bool, inside: tuple[int, ...]):
        self.name, self.order, self.first, self.last, self.hidden, self.inside = name, order, first, None, hidden, inside


#: A start tag ends what is open of the first names, unless one of the others was opened since: HTML lets these end tags out.
ENDS = {"li": (("li",), ("ul", "ol", "table")), "p": (("p",), ("table", "li", "div")), "tr": (("tr",), ("table",)),
        "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}


def elements(html: str, decode: Callable[[str], str] = unescape) -> tuple[list[Node], list[tuple[str, bool]]]:
    """Elements of interest in the order of their start tags, and the text pieces (stripped, and whether hidden) of a page.

    One pass from left to right: an end tag closes the last open element of its name and all that stand open inside; one
    without a start is skipped, and what is open in the end ends there. Script and style hold text up to their own end tag.
    """
    nodes: list[Node] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, Node | None]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    frames: list[int] = []  # orders of the open tables and rows
    waiting: list[str] = []
    hidden = 0

    def flush() -> None:
        if waiting:
            text = decode("".join(waiting)).strip()
            waiting.clear()
            if text:
                pieces.append((text, hidden > 0))

    def close_to(size: int) -> None:
        nonlocal hidden
        while len(stack) > size:
            name, node = stack.pop()
            places[name].pop()
            hidden -= name in HIDDEN
            if node is not None:
                node.last = len(pieces)
                if name in FRAMES:
                    frames.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    at = 0
    while at < len(html):
        found = TOKEN.search(html, at)
        if found is None:
            waiting.append(html[at:])
            break
        waiting.append(html[at:found.start()])
        at = found.end()
        flush()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if places[name]:
                close_to(places[name][-1])
            continue
        if name in ENDS:
            ended, kept = ENDS[name]
            if last(ended) > last(kept):
                close_to(last(ended))
        node = None
        if name in KEPT:
            node = Node(name, len(nodes), len(pieces), hidden > 0, tuple(frames))
            nodes.append(node)
        if name in EMPTY or found[3].endswith("/"):
            if node is not None:
                node.last = len(pieces)
            continue
        places[name].append(len(stack))
        stack.append((name, node))
        hidden += name in HIDDEN
        if name in FRAMES:
            frames.append(node.order)
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = end.start() if end else len(html)
    flush()
    close_to(0)
    return nodes, pieces


def text_of(node: Node, pieces: list[tuple[str, bool]]) -> str:
    return "".join(text for text, hidden in pieces[node.first:node.last] if not hidden)


def page_text(html: str) -> str:
    _, pieces = elements(html)
    return "".join(text for text, hidden in pieces if not hidden)


def page_blocks(html: str, decode: Callable[[str], str] = unescape) -> list[tuple[str, str]]:
    nodes, pieces = elements(html, decode)
    title = next((n for n in nodes if n.name == "title"), None)
    out = [("heading", "".join(t for t, _ in pieces[title.first:title.last]))] if title else []
    seen = [n for n in nodes if not n.hidden]
    out += [("heading", text_of(n, pieces)) for n in seen if n.name in ("h1", "h2", "h3")]
    out += [("paragraph", text_of(n, pieces)) for n in seen if n.name in ("p", "li", "td")]
    return [(kind, text) for kind, text in out if text]


def page_cells(html: str) -> list[tuple[int, int, int, str]]:
    """(table, row, column, text): a table has the rows of tables inside of it, and a row the cells of rows inside of it."""
    nodes, pieces = elements(html)
    seen = [n for n in nodes if not n.hidden]
    cells: dict[int, list[Node]] = {}
    rows: dict[int, list[Node]] = {}
    for n in seen:
        if n.name in ("td", "th", "tr"):
            for order in n.inside:
                if nodes[order].name == "tr" and n.name != "tr":
                    cells.setdefault(order, []).append(n)
                elif nodes[order].name == "table" and n.name == "tr":
                    rows.setdefault(order, []).append(n)
    out = []
    for table_no, table in enumerate(n for n in seen if n.name == "table"):
        filled = [cells[r.order] for r in rows.get(table.order, []) if r.order in cells]
        out += [(table_no, i, j, text_of(c, pieces)) for i, row in enumerate(filled) for j, c in enumerate(row)]
    return out


def _per_page(pages: DataFrame, html: str, fields: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """Other columns of each page and the fields of each row that ``read`` finds in it."""
    names = [c for c in pages.columns if c != html]
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*[pages.schema[n] for n in names], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], [[] for _ in added]
            for i, page in enumerate(batch.column(html).to_pylist()):
                for row in read(page or ""):
                    at.append(i)
                    for column, value in zip(values, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(pa.array(at, pa.int64())) for n in names],
                 *[pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(values, added)]], names=schema.names)

    return pages.select(*names, html).mapInArrow(run, schema)


def html_blocks(pages: DataFrame, html: str = "html", open_references: bool = True) -> DataFrame:
    """Title, then h1-h3 headings, then p/li/td paragraphs, each in document order; one inside another has its own block, and
    the outer one holds its text too. Pages are read one by one, in a narrow pass. HTML reads some character references
    without their semicolon, as ``&amp`` at the end of a cut title; without ``open_references`` these stay as they stand."""
    decode = unescape if open_references else decode_closed
    return _per_page(pages, html, "ordinal int, kind string, text string",
                     lambda page: [(i, *block) for i, block in enumerate(page_blocks(page, decode))])


def html_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of every table, nested ones too: empty rows dropped, row 0 is the header."""
    return _per_page(pages, html, "table_no int, row_no int, col_no int, value string", page_cells)


def xml_blocks(df: DataFrame, raw: str = "raw", max_depth: int = 50) -> DataFrame:
    """'tag: text' of every element with text, in document order; unreadable or too deep gives a warning."""
    keep = [f for f in df.schema.fields if f.name != raw]
    names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType()),
                                  T.StructField("warning", T.StringType())])

    def walk(text: str) -> Iterator[tuple[int | None, str | None, str | None]]:
        if "<!ENTITY" in text:
            yield None, None, "entity declarations are not read"
            return
        try:
            root = ET.fromstring(text)
        except ET.ParseError as exc:
            yield None, None, f"XML parse error: {exc}"
            return
        stack, n, cut = [(root, 0)], 0, False
        while stack:
            node, depth = stack.pop()
            if depth > max_depth:
                cut = True
                continue
            body = (node.text or "").strip()
            if body:
                yield n, f"{node.tag.rsplit('}', 1)[-1]}: {body}", None
                n += 1
            stack.extend((child, depth + 1) for child in reversed(node))
        if cut:
            yield None, None, f"content past {max_depth} levels of nesting was not extracted"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*r[:-1], *b) for r in pdf[[*names, raw]].itertuples(index=False, name=None) for b in walk(r[-1])]
            yield pd.DataFrame(rows, columns=[*names, "ordinal", "text", "warning"]).astype({"ordinal": "Int32"})

    return df.mapInPandas(run, schema)


def geojson_features(df: DataFrame, raw: str = "raw", cut: int | None = None) -> DataFrame:
    """Index, geometry type and properties (JSON text) of each feature."""
    data = F.from_json(raw, "features array<struct<geometry:struct<type:string>,properties:string>>")
    keep = [c for c in df.columns if c != raw]
    rows = df.select(*keep, F.posexplode(data["features"]).alias("feature_index", "f"))
    props = F.coalesce("f.properties", F.lit("{}"))
    return rows.select(*keep, "feature_index", F.coalesce("f.geometry.type", F.lit("")).alias("geometry_type"),
                       (props if cut is None else F.substring(props, 1, cut)).alias("properties"))
