"""Sinks: flat export, nested export sheets, external databases."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.records import EXPORT_EXCLUDED

# Columns every export sheet starts with.
BASE_COLUMNS = ("source_id", "source_name", "source_section", "title", "canonical_url", "external_id")


def flat_columns(df: DataFrame) -> DataFrame:
    """Columns by name, nested values as JSON text, side channels left out."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    columns = []
    for name in sorted(c for c in df.columns if c not in EXPORT_EXCLUDED and not c.startswith("_")):
        value = F.col(f"`{name}`")
        columns.append((F.to_json(value) if isinstance(df.schema[name].dataType, nested) else value).alias(name))
    return df.select(*columns)


def export_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV part files with a header; the mark, when asked for, opens every header."""
    flat = flat_columns(df)
    if byte_order_mark and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    flat.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def export_json(df: DataFrame, path: str) -> None:
    names = sorted(c for c in df.columns if c not in EXPORT_EXCLUDED and not c.startswith("_"))
    df.select(*names).write.mode("overwrite").json(path, ignoreNullFields=False)


def _base(df: DataFrame) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in BASE_COLUMNS]


def table_sheet(records: DataFrame, tables: str = "tables") -> DataFrame:
    """One row per table row of a record: ``tables ARRAY<STRUCT<table_index, rows ARRAY<MAP>>>``."""
    flat = records.select(*_base(records), F.explode(tables).alias("t"))
    return flat.select(*BASE_COLUMNS, "t.table_index", F.posexplode("t.rows").alias("row_index", "row"))


def attachment_sheet(records: DataFrame, attachments: str = "attachments") -> DataFrame:
    """Pages and sheet rows of parsed attachments.

    ``attachments ARRAY<STRUCT<title, url, document STRUCT<filename,
    pages ARRAY<STRUCT<page, text>>, sheets ARRAY<STRUCT<name, rows ARRAY<ARRAY<STRING>>>>>>>``
    """
    flat = records.select(*_base(records), F.explode(attachments).alias("a"))
    common = [
        *[F.col(c) for c in BASE_COLUMNS],
        F.col("a.title").alias("attachment_title"),
        F.col("a.url").alias("attachment_url"),
        F.col("a.document.filename").alias("filename"),
    ]
    pages = flat.select(*common, F.explode("a.document.pages").alias("p")).where("p.text <> ''")
    pages = pages.select("*", F.col("p.page").alias("document_page"), F.col("p.text").alias("document_text")).drop("p")
    sheets = flat.select(*common, F.explode("a.document.sheets").alias("s"))
    rows = sheets.select("*", F.col("s.name").alias("sheet"), F.posexplode("s.rows").alias("document_row_index", "cells")).drop("s")
    return pages.unionByName(rows, allowMissingColumns=True)


def api_sheet(records: DataFrame, payload: str = "official_api") -> DataFrame:
    return records.select(*_base(records), F.explode(F.col(f"{payload}.records")).alias("record"))


def _count(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0))


def tables_summary(tables: Column) -> Column:
    rows = F.aggregate(F.transform(tables, lambda t: F.greatest(_count(t["rows"]), F.lit(0))), F.lit(0), lambda a, b: a + b)
    size = F.when(tables.isNull(), 0).otherwise(F.size(tables))
    return F.concat(size.cast("string"), F.lit(" tables / "), F.coalesce(rows, F.lit(0)).cast("string"), F.lit(" rows"))


def attachments_summary(attachments: Column) -> Column:
    parsed = F.size(F.filter(attachments, lambda a: a["document"].isNotNull()))
    size = F.when(attachments.isNull(), 0).otherwise(F.size(attachments))
    return F.concat(
        size.cast("string"), F.lit(" attachments / "), F.greatest(parsed, F.lit(0)).cast("string"), F.lit(" parsed")
    )


def api_summary(payload: Column) -> Column:
    size = F.greatest(F.coalesce(F.size(payload["records"]), F.lit(0)), F.lit(0))
    return F.concat(F.lit("official API: "), size.cast("string"), F.lit(" records"))


def prepare_for_table(df: DataFrame, table_columns: Sequence[str], mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by mapping and drop columns the target table does not have."""
    mapping = mapping or {}
    pairs = [(c, mapping.get(c, c)) for c in df.columns]
    return df.select(*[F.col(f"`{c}`").alias(t) for c, t in pairs if t in table_columns])


def check_table(table: str, allowed: Sequence[str], schema: str = "public") -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(f"table name is not allowed: {table}")
    qualified = f"{schema}.{table}"
    if allowed and table not in allowed and qualified not in allowed:
        raise ValueError(f"table is not in the allow-list: {qualified}")
    return qualified


def upsert_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New table content: incoming rows replace rows with equal keys."""
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True).select(*existing.columns)
