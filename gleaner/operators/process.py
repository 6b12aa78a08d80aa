"""Row operations: declarative dicts compiled once to columns, applied in order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.context import RunContext
from gleaner.functions import numbers, text
from gleaner.functions.records import path_column
from gleaner.operators import collection, rules

Operation = Mapping[str, Any]


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def _rename(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    source, target = op["field"], op["to"]
    if source not in df.columns:
        return _set(df, target, F.lit(None).cast("string"))
    return (df.drop(target) if target != source else df).withColumnRenamed(source, target)


def _constant(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    return _set(df, op["field"], F.lit(op.get("value")))


def _add_context(df: DataFrame, op: Operation, ctx: RunContext | None) -> DataFrame:
    if ctx is None:
        raise ValueError("add_context needs a run context")
    names = op.get("fields") or ["source_id", "source_name", "fetched_at", "page_url", "state"]
    for name in names:
        if name == "source_id":
            value = F.lit(ctx.source.get("id"))
        elif name == "source_name":
            value = F.lit(ctx.source.get("name"))
        elif name in ("fetched_at", "effective_at", "observed_at"):
            value = F.lit(ctx.clock)
        elif name == "page_url":
            value = F.coalesce(text.non_blank(path_column(df, "url")), path_column(df, "page_url"))
        elif name == "state":
            value = F.coalesce(
                path_column(df, "state"), path_column(df, "_provenance.page.state"), path_column(df, "_provenance.state")
            )
        else:
            value = F.lit(ctx.source.get(name) or ctx.variables.get(name))
        value = value.cast("string")
        if name in df.columns:
            kind = df.schema[name].dataType
            value = F.coalesce(text.non_blank(F.col(name)), value.cast(kind))
        df = _set(df, name, value)
    return df


def _copy(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    return _set(df, op.get("to") or op["field"], path_column(df, op.get("source") or op.get("from") or ""))


def _coalesce(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    sources = op.get("fields") or op.get("sources") or []
    values = [text.non_blank(path_column(df, s)) for s in sources]
    return _set(df, op.get("to") or op["field"], F.coalesce(*values, F.lit(op.get("default"))))


def _text(function: Callable[[Column, Operation], Column]):
    def run(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
        if op["field"] not in df.columns:
            return df
        return _set(df, op["field"], function(F.col(op["field"]).cast("string"), op))

    return run


def _struct(function: Callable[[Column], Column]):
    def run(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
        value = F.coalesce(path_column(df, op["field"]).cast("string"), F.lit(""))
        parsed = df.withColumn("__parsed", function(value))
        names = parsed.schema["__parsed"].dataType.names
        return parsed.withColumns({n: F.col(f"__parsed.{n}") for n in names}).drop("__parsed")

    return run


def _present(df: DataFrame, field: str) -> bool:
    """Whether rows have the field; an absent one leaves the row as it is."""
    return field.split(".")[0] in df.columns


def _map(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    mapping = op.get("mapping") or {}
    if not mapping or not _present(df, op["field"]):
        return df
    value = path_column(df, op["field"]).cast("string")
    pairs = F.create_map(*[F.lit(str(x)) for x in chain.from_iterable(mapping.items())])
    return _set(df, op["field"], F.coalesce(F.try_element_at(pairs, value), value))


def _split(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    if not _present(df, op["field"]):
        return df
    separator = str(op.get("separator", ","))
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return _set(df, op.get("to") or op["field"], F.split(path_column(df, op["field"]).cast("string"), quoted))


def _concat(df: DataFrame, op: Operation, _: RunContext | None) -> DataFrame:
    parts = [F.coalesce(path_column(df, f).cast("string"), F.lit("")) for f in op.get("fields") or []]
    return _set(df, op["field"], F.concat_ws(str(op.get("separator", " ")), *parts))


OPERATIONS: dict[str, Callable[[DataFrame, Operation, RunContext | None], DataFrame]] = {
    "rename": _rename,
    "constant": _constant,
    "add_context": _add_context,
    "copy": _copy,
    "coalesce": _coalesce,
    "trim": _text(lambda c, op: text.strip(c)),
    "normalize_spaces": _text(lambda c, op: text.clean_inline(c)),
    "replace": _text(lambda c, op: F.replace(c, F.lit(str(op.get("search", ""))), F.lit(str(op.get("replacement", ""))))),
    "regex": _text(
        lambda c, op: text.regex_pick(
            c, str(op["pattern"]), int(op.get("group", 0)), "i" in str(op.get("flags", "")), op.get("default")
        )
    ),
    "number": _text(lambda c, op: numbers.parse_double(c)),
    "integer": _text(lambda c, op: numbers.parse_integer(c)),
    "currency": _text(lambda c, op: numbers.parse_currency(c)),
    "term": _struct(numbers.parse_term),
    "rate": _struct(numbers.parse_rate),
    "map": _map,
    "split": _split,
    "concat": _concat,
    "select_by_rules": lambda df, op, ctx: rules.select_by_rules(df, op),
    "classify_access": lambda df, op, ctx: rules.classify_access(df, op),
    "explode": lambda df, op, ctx: collection.explode_field(
        df, op.get("field") or op.get("source"), op.get("target") or op.get("to")
    ),
    "expand_tiers": lambda df, op, ctx: collection.expand_tiers(df, op.get("field") or op.get("source") or "tiers"),
    "unpivot": lambda df, op, ctx: collection.unpivot_operation(df, op),
    "matrix_to_records": lambda df, op, ctx: collection.unpivot_operation(df, op),
    "select_effective_revision": lambda df, op, ctx: collection.effective_operation(df, op, ctx),
}


def apply_operations(df: DataFrame, operations: Sequence[Operation], ctx: RunContext | None = None) -> DataFrame:
    """Unknown operation types leave the rows as they are."""
    for op in operations:
        run = OPERATIONS.get(str(op.get("type") or ""))
        if run is not None:
            df = run(df, op, ctx)
    return df


def with_process_provenance(df: DataFrame, revision: str = "process@2") -> DataFrame:
    """Record which transform revision made a row; earlier provenance is kept."""
    step = F.struct(F.lit(revision).alias("transform_revision"))
    if "_provenance" in df.columns:
        return df.withColumn("_provenance", F.col("_provenance").withField("process", step))
    return df.withColumn("_provenance", F.struct(step.alias("process")))


def map_fields(df: DataFrame, fields: Sequence[Mapping[str, Any]], seq: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """Explicit mapping to business records: ``(records, errors)``.

    ``expression`` is a Spark SQL expression checked against the formula
    allow-list; a failing cast or division gives null and an EXPRESSION error.
    """
    from gleaner.functions.formula import formula

    targets: dict[str, Column] = {}
    problems: list[Column] = []
    for spec in fields:
        target = str(spec.get("target") or spec.get("name") or "")
        if not target:
            problems.append(F.struct(F.lit(None).cast("string").alias("field"), F.lit("TARGET_REQUIRED").alias("code")))
            continue
        default = F.lit(spec.get("default"))
        if spec.get("constant") is not None:
            value = F.lit(spec["constant"])
        elif spec.get("expression"):
            raw = formula(df, str(spec["expression"]))
            value = F.coalesce(raw, default) if spec.get("default") is not None else raw
            inputs = [c for c in df.columns if c in str(spec["expression"])]
            if inputs:
                filled = F.lit(True)
                for name in inputs:
                    filled = filled & F.col(name).isNotNull()
                broken = filled & raw.isNull()
                problems.append(F.when(broken, F.struct(F.lit(target).alias("field"), F.lit("EXPRESSION").alias("code"))))
        else:
            value = path_column(df, str(spec.get("source_path") or spec.get("source") or target))
            if spec.get("default") is not None:
                value = F.coalesce(value, default.cast(_kind(df, value)))
        if spec.get("required"):
            problems.append(
                F.when(text.is_blank(value), F.struct(F.lit(target).alias("field"), F.lit("REQUIRED").alias("code")))
            )
        targets[target] = value
    carried = [c for c in (seq, "_evidence", "_provenance") if c in df.columns]
    found = F.array_compact(F.array(*problems)) if problems else None
    records = df.select(*carried, *[v.alias(k) for k, v in targets.items()])
    if found is None:
        errors = df.select(seq, F.lit("").alias("field"), F.lit("").alias("code")).where(F.lit(False))
    else:
        errors = df.select(seq, F.explode(found).alias("e")).select(seq, "e.field", "e.code")
    return records, errors


def _kind(df: DataFrame, value: Column):
    return df.select(value.alias("v")).schema["v"].dataType


def merge_branches(*branches: DataFrame) -> DataFrame:
    """Union of branch outputs over the union of their columns."""
    merged = branches[0]
    for other in branches[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def merge_fields(branches: Sequence[DataFrame], keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """One row a key with the fields of all branches; of a field that several have, the last branch's.

    A branch has a field if it has the column, so its null replaces an earlier value; keys that only some
    branches have keep those branches' fields.  Within a branch the last row by ``seq`` counts, without one the
    greatest value.  All fields fold in one aggregation with partial results; null keys are equal.
    """
    owners = {c: [n for n, b in enumerate(branches) if c in b.columns] for b in branches for c in b.columns}
    fields = [c for c in owners if c not in keys and c != seq]
    merged = None
    for n, branch in enumerate(branches):
        marked = branch.withColumn("__edge", F.lit(n))
        merged = marked if merged is None else merged.unionByName(marked, allowMissingColumns=True)
    parts = []
    for i, c in enumerate(fields):
        value = F.struct(F.col(f"`{c}`").alias("v"))
        place = F.struct(F.col("__edge"), F.col(seq) if seq else value)
        parts.append(F.max_by(value, F.when(F.col("__edge").isin(*owners[c]), place)).alias(f"__f{i}"))
    rows = merged.groupBy(*keys).agg(*(parts or [F.count("*").alias("__n")]))
    return rows.select(*keys, *[F.col(f"__f{i}")["v"].alias(c) for i, c in enumerate(fields)])
