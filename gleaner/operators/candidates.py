"""Field candidates of pages: elements, tables and JSON-LD as columns for ``markup.schema_first``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions.jsontext import children
from gleaner.operators import structure

ELEMENTS = ("dom", "css", "table")
LINKED = ("json_ld", "jsonld")


def _step(path: str):
    return lambda value: F.try_variant_get(value, path, "variant")


def json_ld_values(html: Column, path: str) -> Column:
    """Values at ``path`` (keys, ``[n]``, ``[*]``) in all readable JSON-LD scripts, in page order."""
    found = F.transform(markup.json_ld(html), lambda body: F.try_parse_json(body))
    pieces = re.split(r"\[\*\]", path.removeprefix("$"))
    for position, piece in enumerate(pieces):
        if piece:
            steps = "$" + (piece if piece.startswith((".", "[")) else f".{piece}")
            found = F.transform(found, _step(steps))
            found = F.filter(found, lambda v: v.isNotNull())
        if position < len(pieces) - 1:
            found = F.flatten(F.filter(F.transform(found, children), lambda v: v.isNotNull()))
    return found


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def from_pages(
    pages: DataFrame, nodes: DataFrame, candidates: Mapping[str, Sequence[Mapping[str, Any]]], key: str = "page_id", html: str = "html"
) -> tuple[DataFrame, dict[str, list[dict[str, Any]]]]:
    """``(rows, candidates)``: pages with a column for each candidate of kind ``dom``, ``css``, ``table`` or ``json_ld``.

    The first three have a ``selector`` (a path of ``structure.element``) and an optional ``attribute``,
    ``json_ld`` has a ``path``; with ``multiple`` the value is the list of all hits in page order, as JSON
    text, else it is the first hit, even where that is empty.  Other candidates stay as they are.  All
    selectors are one pass over the nodes and one aggregation of a page's hits; JSON-LD is
    expressions of the page's row.  A null page, or one without hits, has null values.
    """
    paths: dict[str, Any] = {}
    values: list[Column] = []
    linked: dict[str, Column] = {}
    out: dict[str, list[dict[str, Any]]] = {}
    for number, (target, options) in enumerate(candidates.items()):
        out[target] = []
        for position, option in enumerate(options):
            name = f"__c{number}_{position}"
            ready = {"id": f"{target}:{position}", **option}
            kind = str(option.get("kind") or "path").lower()
            many = bool(option.get("multiple"))
            if kind in ELEMENTS:
                paths[name] = option["selector"]
                value = structure.content(f"@{option['attribute']}" if option.get("attribute") else "text")
                hit = F.struct("node_id", value.alias("v"))
                if many:
                    listed = F.sort_array(F.collect_list(F.when(F.col(name), hit)))
                    values.append(F.to_json(F.transform(listed, lambda e: e["v"])).alias(name))
                else:
                    values.append(F.min_by(hit, F.when(F.col(name), F.col("node_id")))["v"].alias(name))
                shown = option["selector"]
                ready |= {"column": F.col(name), "path": shown.css() if isinstance(shown, structure.Path) else ", ".join(p.css() for p in shown)}
                ready |= {"type": F.lit("array" if many else "string")}
            elif kind in LINKED:
                found = json_ld_values(F.col(html), str(option["path"]))
                if many:
                    linked[name] = F.to_json(found)
                    ready |= {"column": F.col(name), "type": F.lit("array")}
                else:
                    first = F.get(found, F.lit(0))
                    shape = _kind(first)
                    linked[f"{name}_type"] = shape
                    linked[name] = F.when(shape.isin("object", "array"), F.to_json(first)).otherwise(F.try_variant_get(first, "$", "string"))
                    ready |= {"column": F.col(name), "type": F.col(f"{name}_type")}
            out[target].append(ready)
    rows = pages.withColumns(linked) if linked else pages
    if paths:
        hits = structure.reach(nodes, paths, key).groupBy(key).agg(*values)
        rows = rows.join(hits, key, "left")
    return rows, out
