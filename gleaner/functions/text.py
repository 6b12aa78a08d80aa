"""Text cleaning columns."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Unicode white space, including the separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(value: Column) -> Column:
    """Trim both ends; the look-behind keeps long inner runs from being retried at every blank."""
    return F.regexp_replace(value, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def clean_inline(value: Column) -> Column:
    """Collapse every white space run to one blank and trim."""
    return F.trim(F.regexp_replace(value, f"{SPACE}+", " "))


def clean_article(value: Column) -> Column:
    """Clean each line, drop empty lines, separate the rest by a blank line."""
    lines = F.split(F.regexp_replace(value, "\r", ""), "\n")
    cleaned = F.filter(F.transform(lines, clean_inline), lambda line: line != "")
    return F.array_join(cleaned, "\n\n")


def unique_strings(values: Column) -> Column:
    """Cleaned non-empty strings, first occurrence kept in order."""
    return F.array_distinct(F.filter(F.transform(values, clean_inline), lambda v: v != ""))


def is_blank(value: Column) -> Column:
    """Null and empty text count as missing everywhere; zero does not."""
    return value.isNull() | (value.cast("string") == "")


def non_blank(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def java_groups(pattern: str) -> str:
    """Named groups ``(?P<name>…)`` and ``(?P=name)`` as the JVM takes them.

    The JVM allows letters and digits in names only, so groups are called ``g1``, ``g2`` … in
    their order; their numbers stay, and callers read them by number.
    """
    names: dict[str, str] = {}

    def renamed(part: re.Match[str]) -> str:
        opened, referred = part.group(1), part.group(2)
        if opened:
            return f"(?<{names.setdefault(opened, f'g{len(names) + 1}')}>"
        return rf"\k<{names.get(referred, referred)}>" if referred else part.group()

    return re.sub(r"\\.|\(\?P<(\w+)>|\(\?P=(\w+)\)", renamed, pattern, flags=re.S)


@lru_cache(maxsize=4096)
def _compiles(java: str) -> bool:
    try:
        # Spark's own compiler decides, on a constant and once for all rows; no job runs.
        SparkSession.active().sql("SELECT regexp_like('', :pattern)", args={"pattern": java}).collect()
    except PySparkException:
        return False
    return True


def java_pattern(pattern: str, ignore_case: bool = False) -> str | None:
    """The pattern as the JVM takes it, or null, with a warning, where it is none: such a rule has no hit."""
    java = java_groups(pattern)
    java = f"(?iu){java}" if ignore_case else java
    if _compiles(java):
        return java
    warnings.warn(f"not a pattern, so it hits nothing: {pattern}", stacklevel=2)
    return None


def regex_pick(value: Column, pattern: str, group: int = 0, ignore_case: bool = False, default: str | None = None) -> Column:
    java = java_pattern(pattern, ignore_case)
    if java is None:
        return F.when(value.isNotNull(), F.lit(default))
    picked = F.when(value.rlike(java), F.regexp_extract(value, java, group)).otherwise(F.lit(default))
    return F.when(value.isNotNull(), picked)


def field_name(header: Column) -> Column:
    """Structural column name: lower case, non-word runs to ``_``."""
    text = F.lower(strip(F.coalesce(header, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w]+", "_"), "^_+|_+$", "")


def render_template(template: str, lookup: dict[str, Column]) -> Column:
    """``{{path}}`` placeholders become columns; unknown or null ones print nothing."""
    import re

    parts: list[Column] = []
    position = 0
    for match in re.finditer(r"{{\s*([^}]+?)\s*}}", template):
        parts.append(F.lit(template[position:match.start()]))
        key = match.group(1)
        column = lookup.get(key, lookup.get(key.removeprefix("input.")))
        parts.append(F.lit("") if column is None else F.coalesce(column.cast("string"), F.lit("")))
        position = match.end()
    parts.append(F.lit(template[position:]))
    return F.concat(*parts)
