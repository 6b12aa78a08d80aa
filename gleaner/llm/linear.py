"""What the two text classifiers share: labelled samples and scoring by a broadcast table of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scan import bounded_sample


def labelled_sample(frame: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents of each label 0 and 1, in a fixed order.

    Rows without a key, text or label aren't learned from; a key with several labels or
    texts counts once, with its largest label and first text.  Only keys are compared to
    choose the sample, so its texts alone are gathered.
    """
    docs = frame.select(F.col(key).alias("_key"), F.col(text).alias("_text")).na.drop()
    marks = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1)")
    marks = marks.groupBy("_key").agg(F.max("_label").alias("_label"))
    present = docs.select("_key").join(marks, "_key").distinct()
    chosen = bounded_sample(present, "_label", "_key", rows)
    found = docs.join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    order = F.xxhash64("_key", F.lit(11))
    return [(r["_text"], r["_label"]) for r in found.orderBy(order, "_key").collect()]
