"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scan import stored


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link every node's larger (or smaller) neighbours with its least neighbour or itself.

    Least neighbours are partial aggregates and meet the links again by a join, so no node's
    neighbours are gathered.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(``a``, ``b``) of every linked node but the least of its component, which is ``b``.

    ``links`` has columns ``a`` and ``b`` of longs, in any order and number.  No links give
    no rows.  The rounds grow with the logarithm of a component's size.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _digest(edges)
    while before[0]:
        edges = stored(_star(_star(edges, True), False))
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges
