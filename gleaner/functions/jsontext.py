"""JSON payloads: tolerant parsing, paths, nested collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.binding import let, with_once
from gleaner.plans.ranking import top_per_key

# Envelope names around a collection, and url-bearing fields.
ENVELOPES = ("records", "items", "products", "data", "results")
URL_FIELDS = ("url", "href", "link")

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def reply_json(text: Column) -> Column:
    """VARIANT of a model reply: as it is, else its fenced block, else from the first brace."""
    fenced = F.regexp_extract(text, _FENCE, 1)
    tail = F.regexp_extract(text, r"(?s)([{\[].*)$", 1)
    rest = F.when(text.rlike(_FENCE), F.try_parse_json(fenced)).when(tail != "", F.try_parse_json(tail))
    return F.coalesce(F.try_parse_json(text), rest)


def reply_records(value: Column, expect_array: bool = False) -> Column:
    """``array<variant>`` of a reply: a single-key envelope is opened, one object is wrapped."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    options = []
    for name in ENVELOPES:
        items = F.try_variant_get(value, f"$.{name}", "array<variant>")
        allowed = F.lit(expect_array) | (F.size(F.map_keys(fields)) == 1)
        options.append(F.when(allowed, items))
    options.append(F.try_variant_get(value, "$.records", "array<variant>"))
    options.append(F.try_variant_get(value, "$", "array<variant>"))
    options.append(F.when(value.isNotNull(), F.array(value)))
    return F.coalesce(*options)


def children(value: Column) -> Column:
    """Elements of an array or values of an object, as ``array<variant>``."""
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.map_values(F.try_variant_get(value, "$", "map<string,variant>")),
    )


def path_values(df: DataFrame, json: str, path: str, target: str = "value") -> DataFrame:
    """One row per value at ``path`` (keys, ``[n]``, ``[*]``); an absent path gives no row."""
    current = df.withColumn(target, F.try_parse_json(F.col(json)))
    pieces = re.split(r"\[\*\]", path.removeprefix("$"))
    for position, piece in enumerate(pieces):
        if piece:
            steps = "$" + (piece if piece.startswith((".", "[")) else f".{piece}")
            current = current.withColumn(target, F.try_variant_get(F.col(target), steps, "variant"))
        if position < len(pieces) - 1:
            current = current.withColumn(target, F.explode(children(F.col(target))))
    return with_once(current, target, F.col(target), drop_null=True)


_NESTED = """
WITH RECURSIVE nodes({keys}, path, place, value) AS (
  SELECT {keys}, '$', CAST(array() AS ARRAY<BIGINT>), __root FROM {{source}}
  UNION ALL
  SELECT {under}, path || CASE WHEN child.key IS NULL THEN '[*]' ELSE '.' || child.key END, array_append(place, CAST(child.pos AS BIGINT)), child.value
  FROM nodes, LATERAL variant_explode(nodes.value) AS child{limit})
SELECT {keys}, path, place, try_variant_get(value, '$', 'array<variant>') AS items FROM nodes
"""


def nested_arrays(df: DataFrame, json: str, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """Every array inside the payload: its path, its place (child positions) and its items.

    A recursive query opens the values of one level after the other, whatever their depth: each payload is
    parsed once, nothing is exchanged, and no job runs before the result is asked for.
    """
    names = [f"k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.try_parse_json(F.col(json)).alias("__root"))
    limit = "" if max_depth is None else f" WHERE size(place) < {int(max_depth)}"
    listed = ", ".join(names)
    text = _NESTED.format(keys=listed, under=", ".join(f"nodes.{n}" for n in names), limit=limit)
    found = df.sparkSession.sql(text, source=source).where(F.col("items").isNotNull())
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "path", "place", "items")


def url_of(item: Column) -> Column:
    named = [F.try_variant_get(item, f"$.{f}", "string") for f in URL_FIELDS]
    return F.coalesce(*[F.when(n != "", n) for n in named])


def merge_url_lists(df: DataFrame, json: str, key: str, max_depth: int | None = None) -> DataFrame:
    """Distinct urls of all url-bearing lists of a payload; the first place wins."""
    arrays = nested_arrays(df, json, [key], max_depth=max_depth)
    bearing = arrays.where(F.exists("items", lambda v: url_of(v).isNotNull()))
    rows = bearing.select(key, "place", F.posexplode("items").alias("n", "item"))
    plain = F.try_variant_get(F.col("item"), "$", "string")
    text_url = F.when(plain.rlike("^(?:https?://|/)"), plain)
    rows = with_once(rows, "url", F.coalesce(url_of(F.col("item")), text_url), drop_null=True)
    return top_per_key(rows, [key, "url"], [F.col("place"), F.col("n")])


def largest_url_list(df: DataFrame, json: str, key: str, max_depth: int | None = None) -> DataFrame:
    """The list with most url-bearing objects; ties by length, then by place."""
    arrays = nested_arrays(df, json, [key], max_depth=max_depth)
    with_url = F.size(F.filter("items", lambda v: F.coalesce(F.try_variant_get(v, "$.url", "string") != "", F.lit(False))))
    scored = arrays.withColumns({"urls": with_url, "length": F.size("items")}).where("urls > 0")
    return top_per_key(scored, [key], [F.col("urls").desc(), F.col("length").desc(), F.col("place")])


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def schema_hints(df: DataFrame, json: str, key: str, max_depth: int | None = None) -> DataFrame:
    """Per array path: length of the first array there, and the fields of all items of all arrays there.

    A field with values of several kinds names them all, ``null`` only where there is no other.
    """
    arrays = nested_arrays(df, json, [key], max_depth=max_depth)
    entries = F.flatten(F.transform("items", lambda v: F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array())))
    pairs = F.array_distinct(F.transform(entries, lambda e: F.struct(e["key"].alias("f"), F.coalesce(_kind(e["value"]), F.lit("null")).alias("kind"))))
    # Distinct kinds of one array each, so what meets is small.
    rows = arrays.select(key, "path", "place", F.size("items").alias("n"), pairs.alias("pairs"))
    merged = rows.groupBy(key, "path").agg(
        F.min_by("n", "place").alias("n"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )

    def shown(name: Column, all_pairs: Column) -> Column:
        kinds = F.array_sort(F.transform(F.filter(all_pairs, lambda p: (p["f"] == name) & (p["kind"] != "null")), lambda p: p["kind"]))
        return F.concat(name, F.lit(":"), F.when(F.size(kinds) > 0, F.array_join(kinds, "|")).otherwise("null"))

    names = F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["f"])))
    fields = F.array_join(let(F.col("pairs"), lambda every: F.transform(names, lambda f: shown(f, every))), ",")
    return merged.select(
        key, F.concat("path", F.lit("[*]")).alias("json_path"), F.col("n").cast("bigint").alias("length"), F.coalesce(fields, F.lit("")).alias("fields")
    )
