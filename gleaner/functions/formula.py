"""Formula columns: Spark SQL expressions behind an allow-list of functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions a formula may call.
ALLOWED_FUNCTIONS = frozenset(
    """abs add_months between bround case cast ceil coalesce concat concat_ws convert_timezone date_add
    date_format date_sub date_trunc datediff element_at floor greatest if ifnull in least length lower lpad
    make_interval mod nullif nvl pmod pow power regexp_extract regexp_replace round rpad sign size split
    substr substring to_date trim try_add try_cast try_divide try_multiply try_subtract try_to_date
    try_to_timestamp upper and or not when then else end decimal varchar""".split()
)

_NAME_BEFORE_PARENTHESIS = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'")


def check_formula(expression: str) -> None:
    bare = _LITERALS.sub("''", expression)
    if re.search(r"\b(select|from|transform|reflect|java_method)\b", bare, re.I) or ";" in bare:
        raise ValueError("only plain expressions are allowed in a formula")
    for name in _NAME_BEFORE_PARENTHESIS.findall(bare):
        if name.lower() not in ALLOWED_FUNCTIONS:
            raise ValueError(f"function is not allowed in a formula: {name}")


def formula(df: DataFrame, expression: str) -> Column:
    check_formula(expression)
    return F.expr(expression)


def with_formula(df: DataFrame, target: str, expression: str) -> DataFrame:
    return df.withColumn(target, formula(df, expression))


def float_divide(left: Column, right: Column) -> Column:
    """Division is always floating point; by zero gives null."""
    return F.try_divide(left.cast("double"), right.cast("double"))


def signed_modulo(left: Column, right: Column) -> Column:
    """Remainder with the sign of the divisor."""
    rest = F.try_mod(left, right)
    return F.when((rest != 0) & ((rest < 0) != (right < 0)), rest + right).otherwise(rest)
