"""Records-to-records operations: explode, unpivot, tiers, effective revision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.context import RunContext
from gleaner.functions.dates import utc_timestamp
from gleaner.plans.ranking import top_per_key


def _provenance(operation: str, source: Column | str, item: Column | None = None, seq: str = "_seq") -> Column:
    column = F.lit(source) if isinstance(source, str) else source
    fields = [F.lit(operation).alias("operation"), F.col(seq).alias("source_row"), column.alias("source_column")]
    if item is not None:
        fields.append(item.cast("bigint").alias("source_item"))
    return F.struct(*fields)


def _as_array(df: DataFrame, field: str) -> Column:
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return F.col(field)
    return F.when(F.col(field).isNotNull(), F.array(F.col(field)))


def explode_field(df: DataFrame, field: str, target: str | None = None, seq: str = "_seq") -> DataFrame:
    """A list gives one row per item, a scalar one row, null no row."""
    target = target or field
    flat = df.select("*", F.posexplode(_as_array(df, field)).alias("__item", "__value"))
    return flat.withColumns(
        {target: F.col("__value"), "_collection": _provenance("explode", field, F.col("__item"), seq)}
    ).drop("__item", "__value")


def unpivot_columns(
    df: DataFrame,
    ids: Sequence[str],
    selector: str = "*",
    header: str = "dimension_raw",
    value: str = "value_raw",
    skip_empty: bool = False,
    seq: str = "_seq",
) -> DataFrame:
    """Columns matching a glob become rows; the header is the text after the first ``:``."""
    chosen = [c for c in df.columns if c != seq and fnmatchcase(c, selector)]
    keep = [seq, *[i for i in ids if i != seq]]
    wide = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("string").alias(f"__v{i}") for i, c in enumerate(chosen)])
    long = wide.unpivot([F.col(f"`{c}`") for c in keep], [f"__v{i}" for i in range(len(chosen))], "__name", value)
    names = F.create_map(*[F.lit(x) for i, c in enumerate(chosen) for x in (f"__v{i}", c)])
    long = long.withColumn("__column", names[F.col("__name")])
    if skip_empty:
        long = long.where(F.col(value).isNotNull() & (F.col(value) != "") & ~F.col(value).isin("[]", "{}"))
    after = F.regexp_replace(F.col("__column"), "^[^:]*:", "")
    return long.withColumns(
        {header: after, "_collection": _provenance("unpivot", F.col("__column"), seq=seq)}
    ).drop("__name", "__column")


def unpivot_operation(df: DataFrame, op: Mapping[str, Any]) -> DataFrame:
    dims = op.get("dimensionColumns") or op.get("dimension_columns") or {}
    return unpivot_columns(
        df,
        op.get("idFields") or op.get("id_fields") or [],
        str(dims.get("selector") or "*"),
        str(dims.get("headerTarget") or dims.get("header_target") or "dimension_raw"),
        str(dims.get("valueTarget") or dims.get("value_target") or "value_raw"),
        bool(op.get("skipEmpty", op.get("skip_empty", False))),
    )


def expand_tiers(df: DataFrame, field: str = "tiers", seq: str = "_seq") -> DataFrame:
    """Explode a list of objects into columns; tier fields override, the source is dropped."""
    flat = df.select("*", F.posexplode(_as_array(df, field)).alias("__item", "__tier"))
    kind = flat.schema["__tier"].dataType
    columns = (
        {n: F.col(f"__tier.{n}") for n in kind.names} if isinstance(kind, T.StructType) else {field: F.col("__tier")}
    )
    out = flat.withColumns({**columns, "_collection": _provenance("expand_tiers", field, F.col("__item"), seq)})
    gone = ["__item", "__tier"] + ([field] if field not in columns else [])
    return out.drop(*gone)


def effective_revision(
    df: DataFrame,
    at: Column,
    keys: Sequence[str] = (),
    start: str = "effective_from",
    end: str = "effective_to",
    seq: str = "_seq",
) -> DataFrame:
    """The latest revision whose ``[start, end)`` holds ``at``.

    A group without any valid revision is returned unchanged.  Without ``keys``
    all rows are one group.
    """
    begins, ends = _moment(df, start), _moment(df, end)
    valid = F.coalesce(begins <= at, F.lit(True)) & F.coalesce(at < ends, F.lit(True))
    candidates = df.where(valid)
    order = [begins.desc_nulls_last(), F.col(seq)]
    if not keys:
        best = candidates.orderBy(*order).limit(1)
        # One-row existence flag, so the broadcast is bounded.
        flag = best.select(F.lit(True).alias("__found"))
        rest = df.join(F.broadcast(flag), F.lit(True), "left_anti")
        return best.unionByName(rest)
    best = top_per_key(candidates, keys, order)
    known = best.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [df[k].eqNullSafe(known[f"__{k}"]) for k in keys]
    return best.unionByName(df.join(known, same, "left_anti"))


def effective_operation(df: DataFrame, op: Mapping[str, Any], ctx: RunContext | None) -> DataFrame:
    if ctx is None:
        raise ValueError("select_effective_revision needs a run context")
    return effective_revision(
        df,
        ctx.clock_column(),
        op.get("partitionBy") or [],
        op.get("effectiveFromField") or op.get("effective_from_field") or "effective_from",
        op.get("effectiveToField") or op.get("effective_to_field") or "effective_to",
    )


def _moment(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return utc_timestamp(F.col(name)) if isinstance(kind, T.StringType) else F.col(name).cast("timestamp_ntz")
