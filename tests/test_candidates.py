from pyspark.sql import functions as F

from gleaner.operators import candidates, dom, markup
from gleaner.operators.structure import element

PAGE = """<script type="application/ld+json">{"name": "From data", "offers": [{"price": 5}, {"price": "7,5"}], "brand": {"n": 1}}</script>
<script type="application/ld+json">{broken</script><h1></h1><h1>Title</h1><table class=t><tr><td>a</td><td>b</td></tr></table><a href="/x">x</a>"""

SPEC = {
    "name": [
        {"id": "h1", "kind": "dom", "selector": element("h1"), "required": True},
        {"id": "ld", "kind": "json_ld", "path": "$.name"},
    ],
    "prices": [{"id": "ld", "kind": "json_ld", "path": "offers[*].price", "multiple": True}],
    "price": [{"id": "ld", "kind": "json_ld", "path": "$.offers[0].price", "valueType": "number"}],
    "brand": [
        {"id": "text", "kind": "json_ld", "path": "$.name", "valueType": "object"},
        {"id": "ld", "kind": "json_ld", "path": "$.brand", "valueType": "object"},
    ],
    "cells": [{"id": "t", "kind": "table", "selector": element("table", classes=["t"]).descendant("td"), "multiple": True}],
    "link": [{"id": "a", "kind": "css", "selector": element("a"), "attribute": "href", "valueType": "string"}],
    "fixed": [{"id": "c", "kind": "constant", "value": "k"}],
}


def test_candidates_of_each_kind(spark):
    pages = spark.createDataFrame([(0, PAGE), (1, "<p>nothing</p>"), (2, None)], "page_id long, html string")
    rows, spec = candidates.from_pages(pages, dom.dom_nodes(pages), SPEC)
    records, errors = markup.schema_first(rows.withColumn("_seq", F.col("page_id")), spec)
    got = {r["_seq"]: r for r in records.collect()}
    assert sorted(got) == [0, 1, 2]
    row = got[0]
    assert (row["name"], row["price"], row["link"], row["fixed"]) == ("From data", "5", "/x", "k")  # the first h1 is empty
    assert (row["prices"], row["brand"], row["cells"]) == ('[5,"7,5"]', '{"n":1}', '["a","b"]')
    assert row["_evidence"]["cells"]["pointer"] == "table.t td" and row["_evidence"]["brand"]["id"] == "ld"
    for n in (1, 2):
        assert got[n]["fixed"] == "k" and all(got[n][c] is None for c in SPEC if c != "fixed")
    assert {(r["_seq"], r["field"], r["code"]) for r in errors.collect()} == {
        (1, "name", "FIELD_CANDIDATES_EXHAUSTED"), (2, "name", "FIELD_CANDIDATES_EXHAUSTED"),
    }
