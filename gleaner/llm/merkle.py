"""Merkle manifest of a table: leaf digests, a tree per group, a tree over the groups, proofs.

A row's leaf hashes its columns with their lengths.  In each group leaves ascend by a key; runs
of ``fanout`` consecutive nodes become their parent until one node remains, the group's
subroot, and the subroots make the root in the same way.  Slot pivot: conditional aggregates
spread each parent's children into ``fanout`` columns; all columns joined hash it, and the columns
before and after a child's own slot are its siblings.  So a level is one aggregation with
partial sums of a key that no group can make hot (group, parent), siblings need no join, and a
proof goes down from the root, level by level, by joins of unique keys: each level has an eighth
of the rows of the one below.

Leaves get their places by range partitions, whose counts are added up per group, so a group may
hold all rows.  The driver sees the depth and the root only.

Defined cases: a null value is hashed as ``-`` and so differs from an empty text; null groups
are one group, before the others; null keys come first, equal keys go by their leaves, and equal
rows are leaves of their own with proofs of their own; a run of one node is hashed too; a group
of one leaf has that leaf as subroot, and a single group its subroot as root; an empty table gives no
rows and no root; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scan import stored

FANOUT = 8
STEP = "struct<before: string, after: string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: Iterable[Column]) -> Column:
    """Digest of a row's values: ``-`` for null, otherwise byte count, colon and text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``_at``, each row's place in its group ``_g`` from 0, and ``_n``, the size of the group.

    Sorted range partitions are written with running ids, so that places stay the same whoever
    reads them later; a range's rows of one group are counted, and the counts before it shift its ids.
    """
    sort = [F.col(c).asc_nulls_first() for c in ("_g", *order)]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    counts = ranged.groupBy("_g", part).agg(F.min("_id").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("_g")  # one row for each range that the group has rows in
    before = F.sum("n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_g", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"), F.sum("n").over(group).alias("_n"))
    placed = ranged.withColumn("_part", part).join(shifts, ["_g", "_part"])
    return placed.withColumn("_at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def _text(cells: list[Column]) -> Column:
    return F.concat(*[F.coalesce(c["h"], F.lit("")) for c in cells]) if cells else F.lit("")


def _parents(nodes: DataFrame, cell: Column) -> DataFrame:
    """One row a parent with its children in columns ``c0`` … and its digest ``_h``."""
    slot = F.pmod("_at", F.lit(FANOUT))
    spread = [F.first(F.when(slot == i, cell), ignorenulls=True).alias(f"c{i}") for i in range(FANOUT)]
    out = nodes.groupBy("_g", "_n", F.expr(f"_at div {FANOUT}").alias("_at")).agg(*spread)
    return stored(out.withColumn("_h", F.sha2(_text([F.col(f"c{i}") for i in range(FANOUT)]).cast("binary"), 256)))


def _children(parents: DataFrame, keep: list[str]) -> DataFrame:
    """The parents' children again, each with its ``cell`` and its ``step``: the text around its slot."""
    cells = [F.col(f"c{i}") for i in range(FANOUT)]
    rows = [
        F.struct(
            F.lit(i).alias("slot"), cell.alias("cell"),
            F.struct(_text(cells[:i]).alias("before"), _text(cells[i + 1 :]).alias("after")).alias("step"),
        )
        for i, cell in enumerate(cells)
    ]
    out = parents.select("_g", "_n", "_at", *keep, F.explode(F.filter(F.array(*rows), lambda r: r["cell"].isNotNull())).alias("_c"))
    return out.select("_g", "_n", (F.col("_at") * FANOUT + F.col("_c.slot")).alias("_at"), *keep, "_c.cell", "_c.step")


def _depth(rows: int) -> int:
    depth = 0
    while FANOUT**depth < rows:
        depth += 1
    return depth


def _levels(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Tables of the nodes above ``nodes`` (``_g, _n, _at, _h`` and a cell), lowest first; finished groups go no further."""
    levels: list[DataFrame] = []
    for k in range(depth):
        open_ = nodes.where(F.col("_n") > FANOUT**k)
        levels.append(_parents(open_, F.col("_cell")))
        nodes = levels[-1].select("_g", "_n", "_at", "_h", F.struct(F.col("_h").alias("h")).alias("_cell"))
    return levels


def _tops(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """``_g, _h`` of the last node of every group."""
    out = nodes.where(F.col("_n") == 1).select("_g", "_h")
    for k, level in enumerate(levels, 1):
        out = out.unionByName(level.where((F.col("_n") <= FANOUT**k) & (F.col("_n") > FANOUT ** (k - 1))).select("_g", "_h"))
    return out


def _down(levels: list[DataFrame], start: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Paths from the groups' last nodes (``_g, _n, _path``) to the lowest level.

    Returns the lowest level's parents with their path, and the groups of a single node.
    """
    paths = None
    for k in range(len(levels), 0, -1):
        ends = start.where((F.col("_n") <= FANOUT**k) & (F.col("_n") > FANOUT ** (k - 1)))
        ends = ends.select("_g", F.lit(0).cast("long").alias("_at"), "_path", *start.columns[3:])
        paths = ends if paths is None else ends.unionByName(paths)
        paths = levels[k - 1].join(paths, ["_g", "_at"])
        if k > 1:
            below = _children(paths, ["_path", *start.columns[3:]])
            paths = stored(below.select("_g", "_at", F.concat(F.array("step"), "_path").alias("_path"), *start.columns[3:]))
    return paths, start.where(F.col("_n") == 1)


@dataclass
class Manifest:
    """Nodes of the leaves' trees, of the tree over the groups, and the root (None for no rows)."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    root: str | None


def build(rows: DataFrame, leaf_of: Column, group: Column, key: Column, keep: dict[str, Column]) -> Manifest:
    """Hash the rows of a table into trees; ``keep`` goes with each leaf to its proof."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()])
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # null first, bytewise
    hashed = stored(rows.select(named.alias("_g"), key.alias("_key"), leaf_of.alias("_h"), kept.alias("_keep")))
    placed = numbered(hashed, ["_key", "_h"])
    leaves = placed.withColumn("_cell", F.struct(F.col("_h").alias("h"), F.col("_keep").alias("keep"))).drop("_key", "_keep")
    most = leaves.agg(F.max("_n")).first()[0]
    levels = _levels(leaves, _depth(most or 0))
    tops = stored(_tops(levels, leaves))
    groups = numbered(tops.select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "_h"), ["_name"])
    groups = stored(groups.withColumn("_cell", F.struct(F.col("_h").alias("h"), F.col("_name").alias("name"))))
    upper = _levels(groups, _depth(groups.count()))
    last = _tops(upper, groups).first()
    return Manifest(leaves, levels, groups, upper, last["_h"] if last else None)


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf its kept columns (``keep``), ``leaf``, ``subroot`` and ``path``, the siblings up to the root."""
    nothing = F.array().cast(f"array<{STEP}>")
    total = manifest.groups.select("_g", "_n").limit(1).withColumn("_path", nothing)
    parents, single = _down(manifest.upper, total)
    if parents is None:
        subroots = manifest.groups.join(single, ["_g", "_n"]).select(F.col("_name").alias("_g"), "_path", F.col("_h").alias("_subroot"))
    else:
        found = _children(parents, ["_path"])
        subroots = found.select(F.col("cell.name").alias("_g"), F.concat(F.array("step"), "_path").alias("_path"), F.col("cell.h").alias("_subroot"))
    sizes = manifest.leaves.groupBy("_g").agg(F.max("_n").alias("_n"))
    starts = stored(subroots.join(sizes, "_g").select("_g", "_n", "_path", "_subroot"))
    parents, single = _down(manifest.levels, starts)
    alone = manifest.leaves.join(single.drop("_n"), "_g").select(
        F.col("_cell.keep").alias("keep"), F.col("_h").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_path").alias("path")
    )
    if parents is None:
        return alone
    found = _children(parents, ["_path", "_subroot"]).select(
        F.col("cell.keep").alias("keep"), F.col("cell.h").alias("leaf"), F.col("_subroot").alias("subroot"),
        F.concat(F.array("step"), "_path").alias("path"),
    )
    return found.unionByName(alone)


def audit(rows: DataFrame, columns: list[str], group: str, key: str, changed: dict[str, Column], where: Column) -> DataFrame:
    """Prove every row, then check it again with some values changed in the rows ``where`` says so.

    Returns the key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    again = F.when(F.coalesce(where, F.lit(False)), leaf([changed.get(c, F.col(c)) for c in columns]))
    built = build(rows, leaf([F.col(c) for c in columns]), F.col(group), F.col(key), {"key": F.col(key), "again": again})
    root = F.lit(built.root).cast("string")
    found = prove(built).select(
        F.col("keep.key").alias(key), "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("keep.again", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)
