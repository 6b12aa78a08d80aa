"""Run-scoped values shared by all operators of one run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunContext:
    """``clock`` is the effective run time as naive UTC text, never "now"."""

    run_id: str
    clock: str
    source: dict[str, Any] = field(default_factory=dict)
    variables: dict[str, Any] = field(default_factory=dict)

    def clock_column(self) -> Column:
        return F.lit(self.clock).cast("timestamp_ntz")


REVIEW_DEFAULTS = {
    "new": False,
    "changed": False,
    "confidence_below": 0.0,
    "sample_unchanged": 0,
}


def merge_review_policy(*levels: dict[str, Any] | None) -> dict[str, Any]:
    """Dataset < graph < output; missing keys fall back to the defaults."""
    merged = dict(REVIEW_DEFAULTS)
    for level in levels:
        merged.update(level or {})
    return merged
