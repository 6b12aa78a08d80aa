"""Structural selection over parsed nodes: steps to descendants, children and siblings.

A ``Path`` is a chain of element tests, as a CSS selector is: ``element("ul").child("li").descendant("a")``.
Each step is a structural join of the nodes it reaches with the nodes reached before, by their
(``node_id``, ``end_id``) intervals: intervals of one page nest, so a node lies in a reached one just
when the largest end before it is not before it.  Such a join is a running maximum, without pairs of
nodes; children and siblings meet at their parent's id.  All windows are keyed by the page
first, which is one input row of the parser, so a chain of any length costs one exchange of
the nodes that any of its tests accept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import field_name
from gleaner.operators.markup import dedupe_headers, table_records, table_rows
from gleaner.session import cut_finely

OPERATORS = {"=": lambda c, v: c == v, "^=": lambda c, v: c.startswith(v), "$=": lambda c, v: c.endswith(v), "*=": lambda c, v: c.contains(v)}


@dataclass(frozen=True)
class Step:
    """One element test and the way to it: " " descendant, ">" child, "+" next sibling, "~" later sibling."""

    axis: str
    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str, str | None], ...] = ()

    def test(self) -> Column:
        hit = F.lit(True) if self.tag is None else F.col("tag") == self.tag
        if self.id is not None:
            hit = hit & F.col("id").eqNullSafe(F.lit(self.id))
        for name in self.classes:
            hit = hit & F.array_contains("classes", name)
        for name, operator, value in self.attributes:
            found = F.try_element_at("attrs", F.lit(name))
            hit = hit & (found.isNotNull() if value is None else F.coalesce(OPERATORS[operator](found, value), F.lit(False)))
        return hit

    def css(self) -> str:
        plain = (self.tag or "") + (f"#{self.id}" if self.id is not None else "") + "".join(f".{c}" for c in self.classes)
        return (plain + "".join(f"[{n}]" if v is None else f"[{n}{o}'{v}']" for n, o, v in self.attributes)) or "*"


def _step(axis: str, tag: str | None, id: str | None, classes: Sequence[str], attributes: Mapping[str, str | tuple[str, str] | None] | None) -> Step:
    pairs = [(n, *(v if isinstance(v, tuple) else ("=", v))) for n, v in (attributes or {}).items()]
    return Step(axis, tag, id, tuple(classes), tuple(pairs))


@dataclass(frozen=True)
class Path:
    """Steps from anywhere in the page, or (``scoped``) from the container that a list is built of.

    An attribute's value is None for "present", a text for equality or a pair of ``^=``, ``$=`` or
    ``*=`` with a text.
    """

    steps: tuple[Step, ...] = ()
    scoped: bool = False

    def _with(self, axis, tag, id, classes, attributes) -> Path:
        if self.scoped and axis != ">":
            raise ValueError("a path from the container goes by children; others start with element()")
        return replace(self, steps=(*self.steps, _step(axis, tag, id, classes, attributes)))

    def descendant(self, tag=None, id=None, classes=(), attributes=None) -> Path:
        return self._with(" ", tag, id, classes, attributes)

    def child(self, tag=None, id=None, classes=(), attributes=None) -> Path:
        return self._with(">", tag, id, classes, attributes)

    def next(self, tag=None, id=None, classes=(), attributes=None) -> Path:
        return self._with("+", tag, id, classes, attributes)

    def later(self, tag=None, id=None, classes=(), attributes=None) -> Path:
        return self._with("~", tag, id, classes, attributes)

    def css(self) -> str:
        text = ":scope" if self.scoped else self.steps[0].css()
        for step in self.steps if self.scoped else self.steps[1:]:
            text += f" {step.css()}" if step.axis == " " else f" {step.axis} {step.css()}"
        return text


def element(tag=None, id=None, classes=(), attributes=None) -> Path:
    """A path's first element, anywhere in the page."""
    return Path().descendant(tag, id, classes, attributes)


def scope() -> Path:
    """The container itself; ``scope().child(…)`` goes on from it."""
    return Path(scoped=True)


def reach(nodes: DataFrame, paths: Mapping[str, Path | Sequence[Path]], key: str = "page_id", also: Column | None = None) -> DataFrame:
    """Nodes that a path ends at, with one flag a name; several paths of a name are alternatives.

    Nodes for which ``also`` holds stay, too.  ``+`` needs all siblings, so parse without ``tags`` for it.
    """
    chains = [(name, p.steps) for name, given in paths.items() for p in ([given] if isinstance(given, Path) else given)]
    longest = max(len(steps) for _, steps in chains)
    tests = {f"__t{a}_{j}": step.test() for a, (_, steps) in enumerate(chains) for j, step in enumerate(steps)}
    rows = nodes.withColumns({**tests, "__also": F.lit(False) if also is None else also})
    any_test, last = F.col("__also"), F.col("__also")
    for a, (_, steps) in enumerate(chains):
        last = last | F.col(f"__t{a}_{len(steps) - 1}")
        for j in range(len(steps)):
            any_test = any_test | F.col(f"__t{a}_{j}")
    if not any(step.axis == "+" for _, steps in chains for step in steps):
        rows = rows.where(any_test)
    # Only the ends of paths are returned: of the others, the joins need the place alone.
    heavy = [c for c in nodes.columns if c not in (key, "node_id", "end_id", "parent_id")]
    rows = rows.withColumns({c: F.when(last, F.col(c)) for c in heavy})
    if longest > 1:
        cut_finely(nodes.sparkSession)
        rows = rows.repartition(key)
    rows = rows.withColumns({f"__r{a}": F.col(f"__t{a}_0") for a in range(len(chains))})
    page = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    siblings = Window.partitionBy(key, "parent_id").orderBy("node_id")
    for j in range(1, longest):
        here = {a: steps[j].axis for a, (_, steps) in enumerate(chains) if j < len(steps)}
        before: dict[int, Column] = {}
        under = [a for a, axis in here.items() if axis == ">"]
        if under:
            # Reached parents stand beside their children once, at the parent's id.
            parent = F.lit(False)
            for a in under:
                parent = parent | F.col(f"__r{a}")
            marks = F.when(parent, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            rows = rows.withColumn("__mark", F.explode(marks))
            rows = rows.withColumn("__at", F.when(F.col("__mark"), F.col("node_id")).otherwise(F.col("parent_id")))
            at = Window.partitionBy(key, "__at")
            rows = rows.withColumns({f"__p{a}": F.bool_or(F.col("__mark") & F.col(f"__r{a}")).over(at) for a in under})
            rows = rows.where(~F.col("__mark")).drop("__mark", "__at")
            before |= {a: F.col(f"__p{a}") for a in under}
        found = {}
        for a, axis in here.items():
            reached = F.col(f"__r{a}")
            if axis == " ":
                found[f"__p{a}"] = F.max(F.when(reached, F.col("end_id"))).over(page) >= F.col("node_id")
            elif axis == "+":
                found[f"__p{a}"] = F.lag(reached).over(siblings)
            elif axis == "~":
                found[f"__p{a}"] = F.bool_or(reached).over(siblings.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumns(found) if found else rows
        rows = rows.withColumns({f"__r{a}": F.col(f"__t{a}_{j}") & F.coalesce(F.col(f"__p{a}"), F.lit(False)) for a in here})
    flags = {name: F.lit(False) for name in paths}
    for a, (name, _) in enumerate(chains):
        flags[name] = flags[name] | F.col(f"__r{a}")
    rows = rows.withColumns(flags)
    keep = F.col("__also")
    for name in paths:
        keep = keep | F.col(name)
    return rows.where(keep).select(*nodes.columns, *paths)


def content(mode: str = "text") -> Column:
    """Value of a node: ``text``, ``html`` (as written), ``inner``, or ``@name`` for an attribute."""
    return F.try_element_at("attrs", F.lit(mode[1:])) if mode.startswith("@") else F.col(mode)


def select(
    nodes: DataFrame, paths: Path | Sequence[Path], mode: str = "text", single: bool = False, key: str = "page_id", shown_chars: int = 500
) -> DataFrame:
    """Values of all nodes that a path ends at, in page order, with selector and text as evidence.

    ``single`` gives each page's first value and the number of hits.  ``shown_chars`` shortens
    the evidence, never the value.
    """
    given = [paths] if isinstance(paths, Path) else list(paths)
    hits = reach(nodes, {"__hit": given}, key).select(key, "node_id", content(mode).alias("value"))
    shown = F.struct(F.lit(", ".join(p.css() for p in given)).alias("css_selector"), F.substring("value", 1, shown_chars).alias("text"))
    if single:
        first = F.min_by(F.struct("value"), "node_id")["value"]
        return hits.groupBy(key).agg(first.alias("value"), F.count("*").alias("count")).select(key, "value", "count", shown.alias("evidence"))
    return hits.select(key, "node_id", "value", shown.alias("evidence"))


@dataclass(frozen=True)
class Field:
    """One field of a repeating list: where it is (default: the container), what is taken, and its default."""

    path: Path = field(default_factory=scope)
    mode: str = "text"
    default: str | None = None


def repeating(
    nodes: DataFrame, container: Path | Sequence[Path], fields: Mapping[str, Field], key: str = "page_id", shown_chars: int = 500
) -> DataFrame:
    """One row a container with the first hit of each field inside it, and ``evidence`` of the fields found.

    Paths from ``scope()`` are read from the container; others may pass through elements around it,
    as CSS has it, and end inside it.  Every hit is sent to the containers it may belong to, its
    ancestors, and folded there.  A field whose element is missing takes its default; an element
    without the attribute gives null.
    """
    containers = [container] if isinstance(container, Path) else list(container)
    paths: dict[str, list[Path]] = {"__container": containers}
    for i, f in enumerate(fields.values()):
        tail = f.path.steps if f.path.scoped else ()
        paths[f"__hit{i}"] = [Path((*c.steps, *tail)) for c in containers] if f.path.scoped else [f.path]
    hits = reach(nodes, paths, key).withColumns({f"__value{i}": content(f.mode) for i, f in enumerate(fields.values())})
    sent = hits.select(
        key, "node_id", "path", *paths, *[f"__value{i}" for i in range(len(fields))], F.explode("path").alias("__anchor")
    )
    own = F.col("__anchor") == F.col("node_id")
    parts = [F.bool_or(F.col("__container") & own).alias("__is_container")]
    for i, f in enumerate(fields.values()):
        there = F.try_element_at("path", F.lit(-1 - len(f.path.steps))) == F.col("__anchor") if f.path.scoped else ~own
        value = F.struct(F.col("node_id"), F.col(f"__value{i}").alias("value"))
        parts.append(F.min_by(value, F.when(F.col(f"__hit{i}") & there, F.col("node_id"))).alias(f"__field{i}"))
    rows = sent.groupBy(key, "__anchor").agg(*parts).where("__is_container")
    name = ", ".join(c.css() for c in containers)
    values, evidence = [], []
    for i, (target, f) in enumerate(fields.items()):
        found = F.col(f"__field{i}")
        values.append(F.when(found.isNull(), F.lit(f.default)).otherwise(found["value"]).alias(target))
        css = name if f.path.scoped and not f.path.steps else f"{name} {f.path.css()}"
        note = F.struct(F.lit(css).alias("css_selector"), found["node_id"].alias("node_id"), F.substring(found["value"], 1, shown_chars).alias("text"))
        evidence.append(F.struct(F.lit(target).alias("field"), F.when(found.isNotNull(), note).alias("note")))
    seen = F.map_from_entries(F.filter(F.array(*evidence), lambda e: e["note"].isNotNull()))
    return rows.select(key, F.col("__anchor").alias("node_id"), *values, seen.alias("evidence"))


def pick_table(grid: DataFrame, nodes: DataFrame, path: Path | Sequence[Path], table_index: int = 0, key: str = "page_id") -> DataFrame:
    """Rows of the table with this number among those a path ends at; beyond the last, of the first.

    ``table_index`` of the result is that number.  Nodes may be parsed for the path's tags only.
    """
    hits = reach(nodes, {"__hit": path}, key).where(F.col("tag") == "table").select(key, "node_id")
    page = Window.partitionBy(key)  # the tables of one page
    placed = hits.withColumns({"__n": F.row_number().over(page.orderBy("node_id")) - 1, "__all": F.count("*").over(page)})
    wanted = F.when(F.col("__all") > table_index, F.lit(table_index)).otherwise(F.lit(0))
    chosen = placed.where(F.col("__n") == wanted).select(key, "node_id", F.col("__n").alias("__index"))
    return grid.join(chosen, [key, "node_id"]).withColumn("table_index", F.col("__index")).drop("__index")


def parse_tables(
    pages: DataFrame, grid: DataFrame, nodes: DataFrame, path: Path, table_index: int = 0, header_row: int = 0, key: str = "page_id",
    url: str = "url", sample_chars: int = 120,
) -> tuple[DataFrame, DataFrame]:
    """Records of the chosen table of every page, and one row a page that says what was read.

    The second frame has ``columns`` (index, header, sample of the first record), ``mapping_draft``
    (header, field), ``cut`` (a column span was too wide to lay out) and ``error``: TABLE_NOT_FOUND
    where the path ends at no table.
    """
    chosen = pick_table(grid, nodes, path, table_index, key)
    records = table_records(chosen, pages, header_row, None, path.css(), key, url)
    lines = table_rows(chosen, key)
    first = lines.groupBy(key).agg(
        F.max(F.when(F.col("position") == header_row, F.col("cells"))).alias("head"),
        F.max(F.when(F.col("position") == header_row + 1, F.col("cells"))).alias("sample"),
        F.bool_or("cut").alias("cut"),
    )
    found = pages.select(key).join(chosen.groupBy(key).agg(F.lit(True).alias("__found")), key, "left").join(first, key, "left")
    headers = dedupe_headers(F.col("head"))
    found = found.withColumn("headers", headers)
    sample = lambda i: F.substring(F.coalesce(F.get("sample", i), F.lit("")), 1, sample_chars)
    columns = F.transform("headers", lambda h, i: F.struct(i.alias("index"), h.alias("header"), sample(i).alias("sample")))
    named = lambda h, i: F.coalesce(F.nullif(field_name(h), F.lit("")), F.concat(F.lit("column_"), i.cast("string")))
    draft = F.transform("headers", lambda h, i: F.struct(h.alias("header"), named(h, i).alias("field")))
    error = F.when(F.col("__found").isNull(), "TABLE_NOT_FOUND")
    return records, found.select(key, columns.alias("columns"), draft.alias("mapping_draft"), F.coalesce("cut", F.lit(False)).alias("cut"), error.alias("error"))


