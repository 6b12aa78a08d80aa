"""Text rules and filter rules compiled to boolean columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.records import column_type, path_column, truthy_text
from gleaner.functions.text import is_blank, java_pattern

SELECTION_STATES = ("INCLUDE", "EXCLUDE", "AMBIGUOUS")
ACCESS_STATES = ("PUBLIC", "PAYWALLED", "ACCESS_LIMITED")
PASSED = "PASSED_DETERMINISTIC_RULES"


def _as_list(value: Any) -> list[str]:
    values = value if isinstance(value, (list, tuple)) else [value]
    return [str(v) for v in values if v is not None and str(v)]


def _option(spec: Mapping[str, Any], *names: str, default: Any = None) -> Any:
    return next((spec[n] for n in names if n in spec), default)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def rule_hit(df: DataFrame, when: Mapping[str, Any], default_fields: Any) -> tuple[Column, Column]:
    """``(applies, matched terms)`` of one rule over the joined text of its fields."""
    fields = _as_list(when.get("fields", default_fields) or df.columns)
    text = F.concat_ws("\n", *[truthy_text(df, f) for f in fields])
    folded = F.lower(text)
    as_regex = bool(when.get("regex", False))
    ignore_case = bool(_option(when, "ignoreCase", "ignore_case", default=True))

    def hit(pattern: str) -> Column:
        if as_regex:
            java = java_pattern(pattern, ignore_case)
            return F.lit(False) if java is None else text.rlike(java)
        return folded.contains(pattern.lower())

    wanted = _as_list(_option(when, "anyPatterns", "any_patterns", default=[]))
    needed = _as_list(_option(when, "allPatterns", "all_patterns", default=[]))
    barred = _as_list(_option(when, "nonePatterns", "none_patterns", default=[]))
    applies = _all([hit(p) for p in needed]) & ~_any([hit(p) for p in barred])
    if wanted:
        applies = applies & _any([hit(p) for p in wanted])
    terms = [F.when(hit(p), F.lit(p)) for p in (*wanted, *needed, *barred)]
    matched = F.array_compact(F.array(*terms)) if terms else F.array().cast("array<string>")
    return applies, matched


def _first_rule(df: DataFrame, operation: Mapping[str, Any]) -> tuple[Column, Column]:
    """Index of the first rule that applies (null if none) and its matched terms."""
    index = F.lit(None).cast("int")
    terms = F.array().cast("array<string>")
    for i, rule in reversed(list(enumerate(operation.get("rules") or []))):
        applies, matched = rule_hit(df, rule.get("when") or {}, operation.get("fields"))
        index = F.when(applies, F.lit(i)).otherwise(index)
        terms = F.when(applies, matched).otherwise(terms)
    return index, terms


def _evidence(operation: Mapping[str, Any]) -> Column:
    """The terms that were hit and the fields the operation names (none: all were searched)."""
    names = [F.lit(str(f)) for f in _as_list(operation.get("fields") or [])]
    return F.struct(F.col("__terms").alias("matched_terms"), F.array(*names).cast("array<string>").alias("fields"))


def _by_index(index: Column, values: Sequence[str], default: str) -> Column:
    result = F.lit(default)
    for i, value in enumerate(values):
        result = F.when(index == i, F.lit(value)).otherwise(result)
    return result


def select_by_rules(df: DataFrame, operation: Mapping[str, Any]) -> DataFrame:
    rules = operation.get("rules") or []
    default = operation.get("default") or {}
    index, terms = _first_rule(df, operation)
    with_hit = df.withColumns({"__rule": index, "__terms": terms})
    hit = F.col("__rule")

    def state(action: Any) -> str:
        name = str(action or "AMBIGUOUS").upper()
        return name if name in SELECTION_STATES else "AMBIGUOUS"

    return with_hit.withColumns(
        {
            "candidate_status": _by_index(hit, [state(r.get("action")) for r in rules], state(default.get("action"))),
            "selection_rule_id": _by_index(
                hit,
                [str(r.get("id") or "unnamed-rule") for r in rules],
                str(_option(default, "ruleId", "rule_id") or "unclassified-v1"),
            ),
            "selection_reason": _by_index(
                hit,
                [str(r.get("reason") or r.get("id") or "configured selection rule") for r in rules],
                str(default.get("reason") or "no deterministic rule matched"),
            ),
            "selection_evidence": _evidence(operation),
        }
    ).drop("__rule", "__terms")


def classify_access(df: DataFrame, operation: Mapping[str, Any]) -> DataFrame:
    rules = operation.get("rules") or []
    fallback = str(operation.get("default") or "PUBLIC").upper()
    index, terms = _first_rule(df, operation)

    def state(value: str) -> str:
        return value if value in ACCESS_STATES else "ACCESS_LIMITED"

    names = [state(str(r.get("status") or r.get("action") or fallback).upper()) for r in rules]
    out = df.withColumns({"__rule": index, "__terms": terms})
    out = out.withColumns(
        {"access_status": _by_index(F.col("__rule"), names, state(fallback)), "access_evidence": _evidence(operation)}
    ).drop("__rule", "__terms")
    hidden = [f for f in _as_list(_option(operation, "redactFields", "redact_fields", default=[]))]
    if not hidden:
        return out
    public = F.col("access_status") == "PUBLIC"
    return out.withColumns(
        {f: F.when(public, F.col(f)) if f in out.columns else F.lit(None).cast("string") for f in hidden}
    )


def _filter_match(df: DataFrame, rule: Mapping[str, Any]) -> Column:
    field = str(rule.get("field") or "")
    operator = str(rule.get("operator") or "equals").lower()
    expected = rule.get("value")
    value = path_column(df, field)
    text = truthy_text(df, field)
    if operator == "equals":
        return value.eqNullSafe(F.lit(expected))
    if operator == "not_equals":
        return ~value.eqNullSafe(F.lit(expected))
    if operator == "exists":
        return ~is_blank(value)
    if operator == "empty":
        return is_blank(value)
    if operator == "contains":
        return text.contains(str(expected))
    if operator == "regex":
        return text.rlike("(?iu)" + str(expected or ""))
    if operator == "in":
        return value.isin(*(expected if isinstance(expected, (list, tuple)) else [expected]))
    return F.lit(False)


def filter_decision(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> Column:
    """Reason of the first decisive rule, null when the row passes."""
    reasons = []
    for rule in rules:
        match = F.coalesce(_filter_match(df, rule), F.lit(False))
        action = str(rule.get("action") or "exclude").lower()
        label = f"{rule.get('field') or ''}:{str(rule.get('operator') or 'equals').lower()}"
        if action == "exclude":
            reasons.append(F.when(match, F.lit(str(rule.get("reason") or label))))
        elif action == "include_only":
            reasons.append(F.when(~match, F.lit(str(rule.get("reason") or f"{label}:not_matched"))))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def decide_filters(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Decision log columns ``_action`` and ``_reason`` for every row."""
    reason = filter_decision(df, rules)
    return df.withColumn("_reason", reason).withColumns(
        {
            "_action": F.when(F.col("_reason").isNull(), "INCLUDED").otherwise("EXCLUDED"),
            "_reason": F.coalesce(F.col("_reason"), F.lit(PASSED)),
        }
    )


def condition(df: DataFrame, field: str, operator: str = "eq", value: Any = None) -> Column:
    """Branch condition; a null comparison goes to the false branch."""
    left = path_column(df, field)
    kind = column_type(df, field)
    collection = isinstance(kind, (T.ArrayType, T.MapType))
    if operator == "exists":
        result = left.isNotNull()
    elif operator == "empty":
        result = left.isNull() | (F.size(left) == 0) if collection else is_blank(left)
    elif operator == "contains":
        result = F.array_contains(left, value) if isinstance(kind, T.ArrayType) else left.contains(str(value))
    elif operator == "eq":
        result = left.eqNullSafe(F.lit(value))
    elif operator == "ne":
        result = ~left.eqNullSafe(F.lit(value))
    else:
        right = F.lit(value)
        result = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}.get(
            operator, F.lit(False)
        )
    return F.coalesce(result, F.lit(False))


def route(df: DataFrame, field: str, operator: str = "eq", value: Any = None) -> tuple[DataFrame, DataFrame]:
    test = condition(df, field, operator, value)
    return df.where(test), df.where(~test)
