"""Sources: constants, run input, CSV, JSON, XML feeds and binary documents."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.context import RunContext
from gleaner.functions.text import render_template

# Separators tried for a CSV head.
SEPARATORS = (",", ";", "\t", "|")
HEAD_SIZE = 4096


def constant_records(spark: SparkSession, value: Any, context: RunContext | None = None) -> DataFrame:
    """Object, list or scalar as records; template texts are rendered from run variables."""
    items = value if isinstance(value, list) else [value]
    rows = [item if isinstance(item, dict) else {"value": item} for item in items]
    names = list(dict.fromkeys(name for row in rows for name in row))
    parsed = spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], names)
    if context is None:
        return parsed
    lookup = {"run.id": F.lit(context.run_id)} | {k: F.lit(v) for k, v in context.variables.items()}
    templates = {}
    for name, field_type in parsed.dtypes:
        texts = {str(row.get(name)) for row in rows if isinstance(row.get(name), str) and "{{" in str(row.get(name))}
        if field_type != "string" or not texts:
            continue
        rendered = F.col(name)
        for template in texts:
            rendered = F.when(F.col(name) == template, render_template(template, lookup)).otherwise(rendered)
        templates[name] = rendered
    return parsed.withColumns(templates) if templates else parsed


def run_input(spark: SparkSession, context: RunContext) -> DataFrame:
    """Run variables as one initial row."""
    columns = [F.lit(context.run_id).alias("run_id"), *[F.lit(v).alias(k) for k, v in context.variables.items()]]
    return spark.range(1).select(*columns)


def sniff_separator(head: str) -> str:
    """The candidate that splits the header and the first lines most evenly."""
    lines = [line for line in head[:HEAD_SIZE].splitlines() if line][:10]
    if not lines:
        return ","

    def score(separator: str) -> tuple[int, int]:
        counts = [line.count(separator) for line in lines]
        return (sum(c == counts[0] for c in counts) if counts[0] else 0, counts[0])

    return max(SEPARATORS, key=score)


def read_csv(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False, **options: Any) -> DataFrame:
    """CSV files of one separator with a header row; a BOM is dropped.

    Files are split into tasks; ``multi_line`` is for quoted line breaks and reads each file
    in one task.  Files of mixed separators are documents: see ``parse_csv_column``.
    """
    df = spark.read.csv(path, header=True, sep=separator, multiLine=multi_line, escape='"', **options)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def _csv_records(separator: str | None):
    """Text to the records of a CSV document, as header to value; a blank text has none."""

    @F.pandas_udf("array<map<string,string>>")
    def parse(texts: pd.Series) -> pd.Series:
        csv.field_size_limit((1 << 31) - 1)  # a field may be as long as its document

        def records(text: str | None) -> list[dict[str, str]]:
            text = (text or "").lstrip("\ufeff")
            rows = csv.reader(io.StringIO(text, newline=""), delimiter=separator or sniff_separator(text))
            rows = [r for r in rows if any(v.strip() for v in r)]
            return [dict(zip(rows[0], r, strict=False)) for r in rows[1:]]

        return texts.map(records)

    return parse


def parse_csv_column(df: DataFrame, column: str, schema: str, separator: str | None = None) -> DataFrame:
    """CSV document texts to records: one row per record, typed by ``schema`` and bound by header.

    Quoted fields may hold separators and line breaks.  Without ``separator`` each document's
    own head decides.  Fields that a document lacks, and unreadable values, are null.
    """
    fields = StructType.fromDDL(schema).fields
    data = df.select("*", F.posexplode(_csv_records(separator)(F.col(column))).alias("row_index", "__fields"))

    def typed(field):
        text = F.element_at("__fields", field.name)
        blank = text if field.dataType.simpleString() == "string" else F.nullif(F.trim(text), F.lit(""))
        return blank.try_cast(field.dataType).alias(field.name)

    return data.withColumn("record", F.struct(*[typed(f) for f in fields])).drop("__fields")


def read_json(spark: SparkSession, path: str, multi_line: bool = False, **options: Any) -> DataFrame:
    """JSON lines; with ``multi_line`` JSON documents, each file in one task.

    A document's top-level list gives one row per item, an object one row.
    """
    return spark.read.json(path, multiLine=multi_line, **options)


def parse_json_column(df: DataFrame, column: str, target: str = "record") -> DataFrame:
    """JSON document texts to VARIANT records."""
    value = F.try_parse_json(column)
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)))
    return df.select("*", F.posexplode(items).alias("row_index", target))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items of XML files."""
    raw = spark.read.option("rowTag", "item").option("inferSchema", "false").xml(path)
    wanted = {"url": "link", "title": "title", "record_id": "guid"}

    def column(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast("string")
        kind = dict(raw.dtypes)[name]
        return F.col(f"{name}._VALUE") if kind.startswith("struct") and "_VALUE" in kind else F.col(name).cast("string")

    return raw.select(*[F.trim(column(source)).alias(target) for target, source in wanted.items()]).where("url <> ''")


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Documents as bytes with file name and digest."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "modificationTime",
        "length",
        "content",
        F.sha2("content", 256).alias("sha256"),
    )


def document_collection(documents: DataFrame, schema: str | None = None, separator: str | None = None) -> DataFrame:
    """Rows of many CSV and JSON documents with ``url`` and their document provenance."""
    text = documents.select(F.col("path").alias("url"), "filename", F.decode("content", "UTF-8").alias("__text"))
    is_json = F.lower("filename").endswith(".json")
    jsons = parse_json_column(text.where(is_json), "__text").select(
        "url", "filename", "row_index", F.to_json("record").alias("record")
    )
    if schema is None:
        out = jsons
    else:
        csvs = parse_csv_column(text.where(F.lower("filename").endswith(".csv")), "__text", schema, separator).select(
            "url", "filename", "row_index", F.to_json("record").alias("record")
        )
        out = jsons.unionByName(csvs)
    return out.select(
        "url", "record", F.struct(F.col("filename"), F.col("row_index").alias("index")).alias("_document")
    )


def declared(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project an open record to declared columns; missing ones become typed nulls."""
    return df.select(
        *[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()]
    )
