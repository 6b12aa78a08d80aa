"""Validation: row errors, quarantine, coverage, assessment.

Row checks are one array column computed in the scan stage, so clean rows,
quarantined rows and the error list are three filters over the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.records import column_type, path_column
from gleaner.functions.text import is_blank

_ERROR = "struct<field:string,code:string>"

# JSON Schema formats checked by pattern.
FORMATS = {
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "date-time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "email": r"^[^@\s]+@[^@\s]+$",
}


def error(field: str, code: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))


def required_checks(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    return [F.when(is_blank(path_column(df, f)), error(f, "REQUIRED")) for f in fields]


def range_checks(df: DataFrame, ranges: Sequence[Mapping[str, Any]]) -> list[Column]:
    checks = []
    for rule in ranges:
        value = path_column(df, rule["field"])
        bad = F.lit(False)
        if rule.get("min") is not None:
            bad = bad | (value < F.lit(rule["min"]))
        if rule.get("max") is not None:
            bad = bad | (value > F.lit(rule["max"]))
        checks.append(F.when(bad, error(rule["field"], "RANGE")))
    return checks


def _type_ok(kind: T.DataType | None, value: Column, wanted: str) -> Column:
    if kind is None or wanted == "null":
        return value.isNull()
    if isinstance(kind, T.VariantType):
        found = F.schema_of_variant(value)
        names = {
            "string": ["STRING"],
            "integer": ["BIGINT"],
            "number": ["BIGINT", "DOUBLE"],
            "boolean": ["BOOLEAN"],
        }
        if wanted in names:
            decimals = found.startswith("DECIMAL") if wanted == "number" else F.lit(False)
            return found.isin(*names[wanted]) | decimals
        return found.startswith("OBJECT" if wanted == "object" else "ARRAY")
    families: dict[str, Any] = {
        "string": (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType),
        "integer": T.IntegralType,
        "number": T.NumericType,
        "boolean": T.BooleanType,
        "object": (T.StructType, T.MapType),
        "array": T.ArrayType,
    }
    if isinstance(kind, families.get(wanted, ())):
        return F.lit(True)
    if wanted == "integer" and isinstance(kind, T.NumericType):
        return value == F.floor(value)
    return F.lit(False)


def schema_checks(df: DataFrame, schema: Mapping[str, Any]) -> list[Column]:
    """JSON Schema subset compiled to columns: required, type, enum, const,
    pattern, minimum/maximum (also exclusive), minLength/maxLength, format."""
    checks = [F.when(path_column(df, f).isNull(), error(f, "SCHEMA_REQUIRED")) for f in schema.get("required", [])]
    for field, rule in (schema.get("properties") or {}).items():
        value, kind = path_column(df, field), column_type(df, field)
        wanted = rule.get("type")
        present = value.isNotNull()

        def bad(condition: Column, code: str, field: str = field, present: Column = present) -> Column:
            return F.when(present & condition, error(field, code))

        if wanted:
            names = wanted if isinstance(wanted, list) else [wanted]
            fits = F.lit(False)
            for name in names:
                fits = fits | _type_ok(kind, value, name)
            checks.append(bad(~fits, "SCHEMA_TYPE"))
        if "enum" in rule:
            checks.append(bad(~value.isin(*[v for v in rule["enum"] if v is not None]), "SCHEMA_ENUM"))
        if "const" in rule:
            checks.append(bad(value != F.lit(rule["const"]), "SCHEMA_CONST"))
        if "pattern" in rule:
            checks.append(bad(~value.rlike(rule["pattern"]), "SCHEMA_PATTERN"))
        if "minimum" in rule:
            checks.append(bad(value < F.lit(rule["minimum"]), "SCHEMA_MINIMUM"))
        if "maximum" in rule:
            checks.append(bad(value > F.lit(rule["maximum"]), "SCHEMA_MAXIMUM"))
        if "exclusiveMinimum" in rule:
            checks.append(bad(value <= F.lit(rule["exclusiveMinimum"]), "SCHEMA_MINIMUM"))
        if "exclusiveMaximum" in rule:
            checks.append(bad(value >= F.lit(rule["exclusiveMaximum"]), "SCHEMA_MAXIMUM"))
        if "minLength" in rule:
            checks.append(bad(F.char_length(value) < rule["minLength"], "SCHEMA_MIN_LENGTH"))
        if "maxLength" in rule:
            checks.append(bad(F.char_length(value) > rule["maxLength"], "SCHEMA_MAX_LENGTH"))
        if rule.get("format") in FORMATS and isinstance(kind, T.StringType):
            checks.append(bad(~value.rlike(FORMATS[rule["format"]]), "SCHEMA_FORMAT"))
    return checks


def window_checks(df: DataFrame, field: str, lower: Column | None, upper: Column | None) -> list[Column]:
    """Rows outside ``[lower, upper)``; a missing time is outside too."""
    value = path_column(df, field)
    bad = value.isNull()
    if lower is not None:
        bad = bad | (value < lower)
    if upper is not None:
        bad = bad | (value >= upper)
    return [F.when(bad, error(field, "DATE_WINDOW_VIOLATION"))]


def with_errors(df: DataFrame, checks: Sequence[Column]) -> DataFrame:
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast(f"array<{_ERROR}>")
    return df.withColumn("_errors", found)


def error_rows(checked: DataFrame, seq: str = "_seq") -> DataFrame:
    return checked.select(seq, F.explode("_errors").alias("e")).select(seq, "e.field", "e.code")


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantined)``."""
    broken = F.size("_errors") > 0
    return checked.where(~broken).drop("_errors"), checked.where(broken)


def coverage(df: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    """One row per field: share of non-blank values against its minimum."""
    shares = [F.avg((~is_blank(path_column(df, f))).cast("int")).alias(f"s{i}") for i, f in enumerate(minimums)]
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.lit(float(m)).alias("expected"),
            F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 6).alias("actual"),
            (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) >= F.lit(float(m))).alias("passed"),
        )
        for i, (f, m) in enumerate(minimums.items())
    ]
    return df.agg(*shares).select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def missing_states(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected values that never occur; the distinct set stays distributed."""
    seen = df.select(F.col(column).cast("string").alias("state")).where(F.col("state").isin(*expected)).distinct()
    wanted = df.sparkSession.createDataFrame([(s,) for s in expected], "state string")
    return wanted.join(seen, "state", "left_anti")


@dataclass(frozen=True)
class Expectations:
    minimum_records: int = 0
    allow_empty: bool = False
    require_complete: bool = False
    coverage: Mapping[str, float] | None = None
    role_column: str | None = None
    expected_role: str | None = None
    detail_ratio: float | None = None
    document_ratio: float | None = None
    allow_partial_commit: bool = False
    quarantine: bool = False


def assess(checked: DataFrame, want: Expectations, counters: Mapping[str, int] | None = None, seq: str = "_seq") -> DataFrame:
    """One row: counts, status, codes and the commit decision, from one aggregation.

    ``counters`` are the traversal numbers (discovered, succeeded, failed,
    documents_discovered, documents_parsed); missing ones equal the record count.
    """
    counters = counters or {}
    broken = F.size("_errors") > 0
    parts: list[Column] = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(broken).alias("failed_rows"),
        F.coalesce(F.sum(F.size("_errors")), F.lit(0)).alias("row_errors"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("_errors", lambda e: e["code"])))).alias("row_codes"),
    ]
    minimums = dict(want.coverage or {})
    for i, field in enumerate(minimums):
        parts.append(F.avg((~is_blank(path_column(checked, field))).cast("int")).alias(f"share{i}"))
    if want.role_column:
        role = path_column(checked, want.role_column)
        parts.append(F.min_by(role, F.when(~is_blank(role), F.col(seq))).alias("role"))
    row = checked.agg(*parts)
    total = F.col("total")
    discovered = F.lit(counters.get("discovered")).cast("bigint") if "discovered" in counters else total
    succeeded = F.lit(counters.get("succeeded")).cast("bigint") if "succeeded" in counters else total
    checks = [
        F.when(total < want.minimum_records, F.lit("MINIMUM_EXPECTED_RECORDS")),
        F.when(F.lit(want.require_complete and counters.get("failed", 0) > 0), F.lit("INCOMPLETE_SCOPE")),
        F.when((total == 0) & F.lit(not want.allow_empty), F.lit("EMPTY_UNEXPECTED")),
    ]
    short = F.lit(False)
    for i, minimum in enumerate(minimums.values()):
        short = short | ((total > 0) & (F.col(f"share{i}") < float(minimum)))
    checks.append(F.when(short, F.lit("REQUIRED_FIELD_COVERAGE")))
    if want.role_column:
        checks.append(F.when(~F.col("role").eqNullSafe(F.lit(want.expected_role)), F.lit("SOURCE_ROLE_MISMATCH")))
    if want.detail_ratio is not None:
        checks.append(F.when((discovered > 0) & (succeeded / discovered < want.detail_ratio), F.lit("DETAIL_COVERAGE_FAILED")))
    if want.document_ratio is not None and counters.get("documents_discovered"):
        ratio = counters.get("documents_parsed", 0) / counters["documents_discovered"]
        checks.append(F.when(F.lit(ratio < want.document_ratio), F.lit("DOCUMENT_PARSE_INCOMPLETE")))
    # Codes are a fixed small vocabulary, so these sets are bounded.
    all_codes = F.array_union(F.col("row_codes"), F.array_compact(F.array(*checks)))
    left = total - F.when(F.lit(want.quarantine), F.col("failed_rows")).otherwise(F.lit(0))
    no_errors = F.size(all_codes) == 0
    empty_ok = F.when((total == 0) & F.lit(want.allow_empty), F.array(F.lit("EMPTY_VALID_WINDOW"))).otherwise(
        F.array().cast("array<string>")
    )
    return row.withColumns({"codes": all_codes, "left": left}).select(
        total.alias("records"),
        F.col("left").alias("records_left"),
        F.col("row_errors"),
        F.when(no_errors, "PASS").when(F.col("left") > 0, "PARTIAL").otherwise("FAIL").alias("status"),
        F.array_join(F.array_sort(F.concat(F.col("codes"), empty_ok)), "|").alias("codes"),
        (no_errors | ((F.col("left") > 0) & F.lit(want.allow_partial_commit))).alias("commit_allowed"),
    )


def _length(df: DataFrame, name: str) -> Column:
    """Items of a list or map, characters of a text; null for anything else."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(F.col(name))
    return F.char_length(name) if isinstance(kind, T.StringType) else F.lit(None).cast("int")


def postconditions(df: DataFrame, checks: Mapping[str, tuple[Column, str, Any]]) -> DataFrame:
    """Named assertions over aggregates, all evaluated in one pass: ``name, passed``.

    Comparisons (gt, gte, lt, lte, eq, ne) are of numbers; ``equals`` is of any value, ``minItems`` of a list's size,
    ``minLength`` of a list, map or text, and ``exists`` fails for null and anything empty.
    """
    compare = {
        "gt": lambda a, b: a > b,
        "gte": lambda a, b: a >= b,
        "lt": lambda a, b: a < b,
        "lte": lambda a, b: a <= b,
        "eq": lambda a, b: a == b,
        "ne": lambda a, b: a != b,
    }
    cast = lambda value, op: value.cast("double") if op in compare else value
    row = df.agg(*[cast(value, op).alias(f"v{i}") for i, (value, op, _) in enumerate(checks.values())])
    entries = []
    for i, (name, (_, op, limit)) in enumerate(checks.items()):
        value = F.col(f"v{i}")
        if op in compare:
            passed = compare[op](value, F.lit(float(limit)))
        elif op == "equals":
            passed = value.eqNullSafe(F.lit(limit))
        elif op == "minItems":
            passed = _length(row, f"v{i}") >= limit if isinstance(row.schema[f"v{i}"].dataType, T.ArrayType) else F.lit(False)
        elif op == "minLength":
            passed = _length(row, f"v{i}") >= limit
        elif op == "exists":
            passed = value.isNotNull() & F.coalesce(_length(row, f"v{i}") > 0, F.lit(True))
        else:
            raise ValueError(f"unknown check: {op}")
        entries.append(F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed")))
    return row.select(F.explode(F.array(*entries)).alias("p")).select("p.*")
