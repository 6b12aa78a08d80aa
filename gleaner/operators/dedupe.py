"""First-wins deduplication with a decision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.records import path_column
from gleaner.plans.ranking import top_per_key


def _key_columns(df: DataFrame, keys: Sequence[str], seq: str) -> list[Column]:
    if keys:
        return [path_column(df, k) for k in keys]
    whole = [F.col(c) for c in sorted(df.columns) if c != seq and not c.startswith("_")]
    return [F.sha2(F.to_json(F.struct(*whole), {"ignoreNullFields": "false"}), 256)]


def keep_first(df: DataFrame, keys: Sequence[str] = (), seq: str = "_seq") -> DataFrame:
    """First row of every key in ``seq`` order; without keys the whole row is the key."""
    return top_per_key(df, _key_columns(df, keys, seq), [F.col(seq)])


def dedupe_decisions(df: DataFrame, keys: Sequence[str] = (), seq: str = "_seq") -> DataFrame:
    """Every row with ``_kept``; the join runs on the unique ``seq``, so hot keys do not matter."""
    kept = keep_first(df.select(seq, *[c.alias(f"k{i}") for i, c in enumerate(_key_columns(df, keys, seq))]),
                      [f"k{i}" for i in range(max(len(keys), 1))], seq)
    flags = kept.select(seq, F.lit(True).alias("_kept"))
    return df.join(flags, seq, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))


def keep_first_text(df: DataFrame, keys: Sequence[str], seq: str = "_seq") -> DataFrame:
    """Extracted-record form: the key is the pipe-joined text of the key fields.

    Without keys the whole record is the key.
    """
    if not keys:
        return keep_first(df, (), seq)
    text = F.concat_ws("|", *[F.coalesce(path_column(df, k).cast("string"), F.lit("")) for k in keys])
    return top_per_key(df, [text], [F.col(seq)])


def latest(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Newest-first report of at most ``limit`` rows (a per-task top-k, no full sort)."""
    return df.orderBy(*order).limit(limit)
