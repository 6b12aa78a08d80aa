"""Access into records: dotted paths, side-channel rules, stable hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Engine-owned fields, and fields that never make a new revision.
SIDE_CHANNELS = ("raw_artifact", "raw_document_id", "evidence")
VOLATILE = ("fetched_at", "observed_at", "evidence", "raw_artifact", "status_code", "artifacts")
EXPORT_EXCLUDED = ("evidence", "raw_artifact", "status_code", "artifacts")


def column_type(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def path_column(df: DataFrame, path: str) -> Column:
    """``a.b[0]`` into structs, arrays, maps, VARIANT or JSON text; missing gives null."""
    if path in df.columns:
        return F.col(f"`{path}`")
    parts = re.findall(r"[^.\[\]]+", path)
    if not parts or parts[0] not in df.columns:
        return F.lit(None).cast("string")
    head, rest = parts[0], parts[1:]
    current = F.col(f"`{head}`")
    kind = column_type(df, head)
    for index, part in enumerate(rest):
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(current, json_path(rest[index:]), "string")
        if isinstance(kind, T.StringType):
            return F.get_json_object(current, json_path(rest[index:]))
        if isinstance(kind, T.StructType) and part in kind.names:
            current, kind = current.getField(part), kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            current, kind = F.get(current, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.MapType):
            current, kind = F.try_element_at(current, F.lit(part)), kind.valueType
        else:
            return F.lit(None).cast("string")
    return current


def json_path(parts: Sequence[str]) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)


def truthy_text(df: DataFrame, path: str) -> Column:
    """Text of a field for rules: null, zero and false count as empty."""
    value = path_column(df, path)
    text = F.coalesce(value.cast("string"), F.lit(""))
    kind = column_type(df, path)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.when(value.cast("double") == 0, F.lit("")).otherwise(text)
    return text


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c not in SIDE_CHANNELS]


def content_hash(columns: Sequence[str]) -> Column:
    """sha256 over the declared columns, sorted by name, volatile ones left out."""
    names = sorted(c for c in columns if c not in VOLATILE)
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def short_identity(columns: Sequence[str]) -> Column:
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 16)
