"""One distributed parse of markup into relational rows.

``dom_nodes`` and ``table_grid`` are the only Python functions on the data path.
They read Arrow batches, keep one page in memory at a time and emit flat rows;
selecting, grouping and joining is left to Spark.
"""

from __future__ import annotations

import sys
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import count, takewhile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The parser travels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and elements that close an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]),
}
SCOPE = frozenset(["table", "ul", "ol", "dl", "select", "body", "html"])

NODE_COLUMNS = (
    "node_id int, end_id int, parent_id int, depth int, tag string, id string, "
    "classes array<string>, attrs map<string,string>, path array<int>, text string, html string, inner string"
)
ROW_COLUMNS = "table_index int, row_index int, in_head boolean, cells array<string>, own_cells array<string>, node_id int, cut boolean"
#: Tags, "all", "classed" (text only), or a rule over tag and attributes.
Wanted = str | tuple[str, ...] | Callable[[str, dict[str, str]], bool]


def squeeze(parts: list[str]) -> str:
    """Text pieces trimmed and joined by a blank, as visible text reads."""
    return " ".join(filter(None, (p.strip() for p in parts)))


# A sign of a reference, with its name where it is closed by a semicolon and isn't a number.
REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z][A-Za-z0-9]*;)?")


# Text and the plain tag after it; anything else in a page is left to ``HTMLParser``.
_ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z][a-zA-Z0-9:_-]*)(?:="([^"<>&]*)"|='([^'<>&]*)'|=([^\s"'=<>`&]+)(?=[ \t\n\r\f>]))?(?=[ \t\n\r\f/>])"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
_NAME = "[a-zA-Z][a-zA-Z0-9-]*"
TOKEN = re.compile(f"([^<]*)<(?:/({_NAME})>|({_NAME})((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \\t\\n\\r\\f]*(/?)>)")
# Fixed value: elements whose content isn't markup.
RAW = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())

# The end of an element whose content is passed over; anything but a plain end tag is left to ``HTMLParser``.
PASSED = {tag: re.compile(f"</{tag}(?=[ \\t\\n\\r\\f/>])", re.IGNORECASE) for tag in ("script", "style")}

KNOWN: dict[str, dict[str, str]] = {}  # attributes of plain tags seen before, at most 4,096


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a plain tag; the first of a name counts."""
    if (found := KNOWN.get(source)) is None:
        if len(KNOWN) >= 4096:
            KNOWN.clear()
        found = KNOWN[source] = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(source + ">")))}
    return found


class _Node:
    __slots__ = ("attrs", "depth", "end", "index", "inner", "outer", "parent", "path", "tag", "text")

    def __init__(self, index: int, parent: _Node | None, tag: str, attrs: dict[str, str]):
        self.index, self.parent, self.tag, self.attrs = index, parent, tag, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.path = [*parent.path, index] if parent else [index]
        self.end = index
        self.text: list[tuple[int, str]] = []
        self.outer = self.inner = (0, 0)  # places in the source


class _Builder(HTMLParser):
    """Pre-order node list; ``pieces`` holds the text in document order."""

    def __init__(self, source: str, closed: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.source = source
        # Stands for the signs that begin no closed reference; one character, so that places stay.
        self.mask = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in source), "") if closed else ""
        self.at = 0  # place in the source
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.mask:
            attrs = [(k, v and v.replace(self.mask, "&")) for k, v in attrs]
        self._start(tag, {k: v or "" for k, v in reversed(attrs)}, self.at + len(self.get_starttag_text() or ""))

    def _start(self, tag: str, attrs: dict[str, str], after: int) -> None:
        while self.open and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self._close_top()
        if tag in ("li", "dt", "dd", "td", "th", "tr", "tbody", "tfoot"):
            self._close_implied(tag)
        node = _Node(len(self.nodes), self.open[-1] if self.open else None, tag, attrs)
        node.outer, node.inner = (self.at, after), (after, after)
        self.nodes.append(node)
        self.starts.append(len(self.pieces))
        self.stops.append(len(self.pieces))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self._end_void()

    def _end_void(self) -> None:
        if self.open and self.open[-1].index == len(self.nodes) - 1:
            self._close_top()

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open):
            while (node := self._close_top()).tag != tag:
                pass
            # The end tag belongs to its element.
            node.outer = (node.outer[0], self.source.find(">", node.inner[1]) + 1 or len(self.source))

    def updatepos(self, i: int, j: int) -> int:
        self.at += max(j - i, 0)
        return max(i, j)

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1].tag not in ("script", "style"):
            self.pieces.append(data.replace(self.mask, "&") if self.mask else data)

    def read(self) -> None:
        mask = self.mask
        text = REFERENCE.sub(lambda m: m[0] if m[1] in html5 else mask + (m[1] or ""), self.source) if mask else self.source
        self.feed(text[self._plain(text):])
        self.finish()

    def _plain(self, text: str) -> int:
        """Read plain tags from the start; the place of the first that isn't one."""
        at, mask = 0, self.mask
        while (m := TOKEN.match(text, at)) and (m[3] is None or not (mask and mask in m[4])):
            tag, end = m[3] and m[3].lower(), None
            if tag in RAW:
                end = None if m[5] or tag not in PASSED else PASSED[tag].search(text, m.end())
                if end is None or text[end.end()] != ">" or text.find("<!--", m.end(), end.start()) >= 0:
                    break
            if m[1]:
                self.handle_data(unescape(m[1]) if "&" in m[1] else m[1])
            self.at, at = m.end(1), m.end()
            if m[3] is None:
                self.handle_endtag(m[2].lower())
            else:
                self._start(tag, _attributes(m[4]), at)
                if m[5]:
                    self._end_void()
                if end:
                    self.at, at = end.start(), end.end() + 1
                    self.handle_endtag(tag)
        self.at = at
        return at

    def _close_implied(self, tag: str) -> None:
        """Close an open sibling of the same kind up to the nearest list or table."""
        for position in range(len(self.open) - 1, -1, -1):
            if tag in CLOSED_BY.get(self.open[position].tag, ()):
                while len(self.open) > position:
                    self._close_top()
                return
            if self.open[position].tag in SCOPE:
                return

    def _close_top(self) -> _Node:
        node = self.open.pop()
        node.end = len(self.nodes) - 1
        self.stops[node.index] = len(self.pieces)
        end = max(self.at, node.inner[0])
        node.outer, node.inner = (node.outer[0], end), (node.inner[0], end)
        return node

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close_top()

    def text_of(self, node: _Node) -> str:
        return squeeze(self.pieces[self.starts[node.index]:self.stops[node.index]])


def parse(html: str | None, closed: bool = False) -> _Builder:
    builder = _Builder(html or "", closed)
    builder.read()
    return builder


def _wants(wanted: Wanted, node: _Node, classes: list[str]) -> bool:
    if callable(wanted):
        return wanted(node.tag, node.attrs)
    return wanted == "all" or bool(classes if wanted == "classed" else node.tag in wanted)


def _node_rows(html: str | None, tags: frozenset[str] | None, text_for: Wanted, html_for: Wanted, closed: bool) -> Iterator[tuple]:
    tree = parse(html, closed)
    for node in tree.nodes:
        if tags is not None and node.tag not in tags:
            continue
        classes = node.attrs.get("class", "").split()
        yield (
            node.index,
            node.end,
            node.parent.index if node.parent else None,
            node.depth,
            node.tag,
            node.attrs.get("id"),
            classes,
            list(node.attrs.items()),
            node.path,
            tree.text_of(node) if _wants(text_for, node, classes) else None,
            *([tree.source[slice(*node.outer)], tree.source[slice(*node.inner)]] if _wants(html_for, node, classes) else [None, None]),
        )


# Fixed value: the HTML standard's own limit of a column span.
MOST_COLUMNS = 1000


def _span(node: _Node, name: str) -> int:
    """Span of a cell; unreadable values count as one, and digits beyond the tenth as a very wide one."""
    value = (node.attrs.get(name) or "1").strip().lstrip("0")
    return int(value[:10]) if value.isdecimal() else 1


def _tables(tree: _Builder) -> Iterator[list[tuple[_Node, list[_Node]]]]:
    """Rows of each table, in order, with their own cells."""
    inside: dict[int, list[tuple[_Node, list[_Node]]]] = {n.index: [] for n in tree.nodes if n.tag == "table"}
    cells: dict[int, list[_Node]] = {}
    for node in tree.nodes:
        if node.tag == "tr" and (around := [i for i in node.path[:-1] if i in inside]):
            inside[around[-1]].append((node, cells.setdefault(node.index, [])))
        elif node.tag in ("td", "th") and node.parent is not None and node.parent.index in cells:
            cells[node.parent.index].append(node)
    yield from inside.values()


def _grid_rows(html: str | None) -> Iterator[tuple]:
    """Rows of every table: each cell claims the rectangle of places that its spans name.

    A cell starts at the first place of its row that no cell above has claimed; a row ends
    at its first place that none has.  Row spans end with the table.  A column span above the
    standard's limit is cut to it, and the row says so.
    """
    tree = parse(html)
    nodes = [n.index for n in tree.nodes if n.tag == "table"]
    for table_index, rows in enumerate(_tables(tree)):
        places: dict[tuple[int, int], str] = {}
        for r, (row, cells) in enumerate(rows):
            texts = [tree.text_of(cell) for cell in cells]
            at, cut = 0, False
            for cell, text in zip(cells, texts, strict=True):
                at = next(c for c in count(at) if (r, c) not in places)
                width, height = min(_span(cell, "colspan"), MOST_COLUMNS), min(_span(cell, "rowspan"), len(rows) - r)
                cut = cut or _span(cell, "colspan") > MOST_COLUMNS
                places.update(((r + y, at + x), text) for y in range(height) for x in range(width))
                at += width
            line = [places[r, c] for c in takewhile(lambda c, r=r: (r, c) in places, count())]
            yield (table_index, r, any(tree.nodes[i].tag == "thead" for i in row.path), line, texts, nodes[table_index], cut)


_NODE_SCHEMA = pa.schema(
    [
        ("node_id", pa.int32()),
        ("end_id", pa.int32()),
        ("parent_id", pa.int32()),
        ("depth", pa.int32()),
        ("tag", pa.string()),
        ("id", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("path", pa.list_(pa.int32())),
        ("text", pa.string()),
        ("html", pa.string()),
        ("inner", pa.string()),
    ]
)
_ROW_SCHEMA = pa.schema(
    [
        ("table_index", pa.int32()),
        ("row_index", pa.int32()),
        ("in_head", pa.bool_()),
        ("cells", pa.list_(pa.string())),
        ("own_cells", pa.list_(pa.string())),
        ("node_id", pa.int32()),
        ("cut", pa.bool_()),
    ]
)
_ROWS_PER_BATCH = 4096


def _flat_map(pages: DataFrame, key: str, html: str, columns: str, schema: pa.Schema, rows_of) -> DataFrame:
    """Apply ``rows_of(html)`` to each page and stream the rows out in small batches."""
    source = pages.select(key, html)
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            full = pa.schema([pa.field(key, keys.type), *schema])
            ids: list = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                arrays = [pa.array(ids, keys.type)]
                for position, field in enumerate(schema):
                    arrays.append(pa.array([r[position] for r in rows], field.type))
                ids.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(arrays, schema=full)

            for position in range(batch.num_rows):
                page = keys[position].as_py()
                for row in rows_of(texts[position].as_py()):
                    ids.append(page)
                    rows.append(row)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield flush()
            if rows:
                yield flush()

    return source.mapInArrow(run, f"{key} {key_type}, {columns}")


def dom_nodes(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    tags: tuple[str, ...] | None = None,
    text_for: Wanted = "all",
    html_for: Wanted = (),
    closed_references: bool = False,
) -> DataFrame:
    """Nodes in document order: ``end_id`` is the last descendant, ``path`` the
    ancestors and the node itself.

    ``tags`` limits which nodes leave the parser; ``text_for`` ("all", "classed" or
    a list of tags) limits which of them carry their text, because every outer
    element repeats the text of its inner ones.  ``html_for`` does the same for ``html``, the
    element as written, and ``inner``, its content.

    Character references are read as the HTML standard has it, some without their semicolon too;
    with ``closed_references`` only those with one are, as in ``functions.markup.unescape``.
    """
    wanted = frozenset(tags) if tags else None
    return _flat_map(pages, key, html, NODE_COLUMNS, _NODE_SCHEMA, lambda text: _node_rows(text, wanted, text_for, html_for, closed_references))


def table_grid(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Table rows: ``cells`` with spans laid out, ``own_cells`` as written."""
    return _flat_map(pages, key, html, ROW_COLUMNS, _ROW_SCHEMA, _grid_rows)
