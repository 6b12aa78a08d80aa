"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of at least ``threshold`` similarity and sizes x <= y differ in at most
``H = (1 - t) / (1 + t) * (x + y)`` tokens.  Tokens are hashed into ``m`` segments, ``m`` by
size band (sizes from a power of two to the next); a different token spoils one segment, so
among any ``H + 1`` segments one is the same in both sets.

* Index: each set's segments as 64-bit hashes, for the band of its size.  The first few
  segments also give their one-deletion neighbourhoods: the segment without each token.
* Probe: each set probes its own band for sets not larger, and the band below where sizes
  allow.  A segment of no tokens is never matched.  An indexed one-deletion neighbourhood
  counts as another unit, as a hit then needs two different tokens to be missed.
* Allocation: a probe has more units than ``H + 1`` and spends those of the least cost, the
  number of sets behind a hash.  Units behind which no other set stands cost nothing; a set
  with ``H + 1`` of them has no partner and is left out.
* Verification: each set has a sketch, the parities of its tokens by 1024 hash values.  Sets
  differ in at least as many tokens as their sketches in bits, which rules out most false
  candidates; the rest meet their texts and are counted exactly.

Equal sets are one node.  Groups of near copies don't become all pairs: each set is first
verified with the few sets that it meets most, then, for units of large groups, with a few
of those behind each; what is linked is one component, and only candidates between different
components are verified after that.  So links inside a known
component are not looked at, and components are exact.

Sets and tokens are known by 64-bit hashes; the counts of a candidate are exact but for a
hash collision inside the two sets.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a
text under ``words`` words is one token; rows with equal sets are one component whatever their
keys; a null key keeps its row, and is never the component's name; a component of null keys
only is named null; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.scan import SMALL_BATCH_BYTES, batch_bytes, complete, may_hold, mix, passes, runs, signed, stored, windows

# Roles of a segment row: probe and index of the own band, index only, probe of the band
# below; the same of a segment with neighbourhood; the neighbourhoods; a set short of units.
OWN, INDEX, LOWER, OWN_FIRST, LOWER_FIRST, OWN_LESS, LOWER_LESS, THIN = range(8)
PROBES = (OWN, LOWER, OWN_FIRST, LOWER_FIRST, OWN_LESS, LOWER_LESS)
INDEXED = (OWN, INDEX, OWN_FIRST, OWN_LESS)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  # least 100 * intersection / union
    filter_bits: int = 1 << 26  # prefilter of texts to verify; changes no result

    sketch: int = 16  # 64-bit words; changes no result
    first: int = 3  # sets that a set is compared with at first; changes no result
    least: int = 32  # units a set carries to bring a pair up once; changes no result
    few: int = 8  # sets that a unit of a large group is compared with at a time; changes no result
    turns: int = 4  # most times that it is; changes no result
    enough: int = 1000  # pairs that are left to the last comparison of all; changes no result

    def budget(self, total):
        """Most different tokens of sets of ``total`` tokens together."""
        return (100 - self.percent) * total // (100 + self.percent)


def _listed(size: int, m: int, s: Settings) -> int:
    """Segments a probe of this size looks at: enough that, bar one set in 10^9, ``H + 1`` have tokens."""
    need, empty = s.budget(2 * size) + 1, math.exp(-size / m)
    return min(m, math.ceil((1.05 * need + 6 * math.sqrt(need * empty) + 1) / (1 - empty)))


@lru_cache(maxsize=1 << 16)
def _indexed(size: int, m: int, s: Settings) -> int:
    """Segments a set of this size is indexed by: all that a probe of any size from its own on looks at.

    ``_listed`` falls between the steps of the budget, so the largest partner isn't the one that looks at most.
    """
    return max(_listed(x, m, s) for x in range(size, size * 100 // s.percent + 1))


@lru_cache(maxsize=64)
def segments(band: int, s: Settings) -> tuple[int, int]:
    """Number of segments of sets of ``2^band`` to ``2^(band+1) - 1`` tokens, and those with neighbourhoods."""
    top = math.ceil(((2 << band) - 1) * 100 / s.percent)
    m = max(64 if band < 4 else 16, s.budget(2 * top) + 2)
    while _listed(top, m, s) >= m and m < 2 * top:
        m += max(1, m // 50)
    return m, (m if band < 3 else 1 + m // 48)


class Sets:
    """Distinct tokens of some texts, in text order: ``token[first[i]:first[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, s: Settings):
        words = runs(data, offsets, lower=True)
        count = np.diff(words.first)
        places, full = complete(words.first, s.words)
        token = windows(words.hash, s.words)[places]
        owner = np.repeat(np.arange(len(count)), full)
        short = []
        for size in range(1, s.words):
            rows = np.flatnonzero(count == size)
            if len(rows):
                short.append((windows(words.hash, size)[words.first[rows]], rows))
        if short:
            token = np.concatenate([token, *[t for t, _ in short]])
            owner = np.concatenate([owner, *[r for _, r in short]])
            order = np.argsort(owner, kind="stable")
            token, owner = token[order], owner[order]
        # Few tokens recur in a text: one sort of (text, token) hashes finds them.
        pair = mix(token + mix(owner.astype(np.uint64)))
        ranked = np.sort(pair)
        again = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(again):
            again = np.unique(again)
            at = np.searchsorted(again, pair)
            often = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == pair)
            often = often[np.lexsort((token[often], owner[often]))]
            old = (token[often][1:] == token[often][:-1]) & (owner[often][1:] == owner[often][:-1])
            keep = np.ones(len(token), bool)
            keep[often[1:][old]] = False
            token, owner = token[keep], owner[keep]
        self.token, self.owner = token, owner
        self.first = np.searchsorted(self.owner, np.arange(len(count) + 1))
        self.size = np.diff(self.first)

    def names(self) -> np.ndarray:
        """64-bit name of each set; sizes and tokens decide it."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.token), dtype=np.uint64)])
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        a, b = (x[self.first[1:]] - x[self.first[:-1]] for x in (total, other))
        return mix(a + mix(b + self.size.astype(np.uint64)))


    def sketches(self, s: Settings) -> np.ndarray:
        """Parity of the number of tokens by hash value, ``s.sketch`` words a set."""
        bits = s.sketch * 64
        at = self.owner * bits + (mix(self.token + np.uint64(99)) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(at, minlength=len(self.size) * bits) & 1
        return np.packbits(odd.astype(bool)).view(np.int64).reshape(len(self.size), s.sketch)


def _sums(values: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by slot, from two exact halves."""
    low = np.bincount(slots, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(slots, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def _segment_rows(sets: Sets, rows: np.ndarray, names: np.ndarray, s: Settings) -> Iterator[tuple]:
    """Columns sig, node, size, slack, role of the chosen texts' sets."""
    size = sets.size
    band = np.zeros(len(size), np.int64)
    band[size > 0] = np.frexp(size[size > 0])[1] - 1
    for lower in (False, True):
        for b in np.unique(band[rows]):
            chosen = rows[band[rows] == b]
            scheme = int(b)
            if lower:
                scheme -= 1
                if scheme < 0:
                    continue
                chosen = chosen[size[chosen] * s.percent <= ((1 << b) - 1) * 100]
            if not len(chosen):
                continue
            m, first = segments(scheme, s)
            n = size[chosen]
            if lower:
                budget = s.budget(n + (1 << int(b)) - 1)
            else:
                budget = s.budget(2 * n)
            probe = np.array([_listed(int(x), m, s) for x in n])
            index = probe if lower else np.array([_indexed(int(x), m, s) for x in n])
            at = np.concatenate([np.arange(a, z) for a, z in zip(sets.first[chosen], sets.first[chosen + 1], strict=True)])
            doc = np.repeat(np.arange(len(chosen)), n)
            token = sets.token[at]
            place = (mix(token + np.uint64(scheme + 1)) % np.uint64(m)).astype(np.int64)
            slot, total = doc * m + place, len(chosen) * m
            mixed = mix(token ^ np.uint64(0x0F0F0F0F0F0F0F0F))
            sums, count = _sums(mixed, slot, total), np.bincount(slot, minlength=total)
            segment = np.tile(np.arange(m), len(chosen))
            owner = np.repeat(np.arange(len(chosen)), m)
            salt = (np.arange(m, dtype=np.uint64) << np.uint64(8)) + np.uint64(scheme)
            used = count > 0
            units = np.bincount(owner[used & (segment < probe[owner])], minlength=len(chosen))
            # Without its token a segment of one is empty, and empty ones aren't met: no second unit.
            double = (count > 1) & (segment < first)
            units += np.bincount(owner[double], minlength=len(chosen))
            slack = units - (budget + 1)
            thin = np.flatnonzero(slack < 0)
            if len(thin):
                names_of = names[chosen[thin]]
                yield mix(names_of), names_of, n[thin], slack[thin], np.full(len(thin), THIN)
            listed = np.flatnonzero(used & (segment < index[owner]))
            role = np.where(double[listed], LOWER_FIRST if lower else OWN_FIRST, LOWER if lower else OWN)
            role = np.where(segment[listed] >= probe[owner[listed]], INDEX, role)
            yield mix(sums[listed] + mix(salt)[segment[listed]]), names[chosen[owner[listed]]], n[owner[listed]], slack[owner[listed]], role
            near = np.flatnonzero(place < first)
            if len(near):
                less = mix(sums[slot[near]] - mixed[near] + mix(salt)[place[near]])
                role = np.full(len(near), LOWER_LESS if lower else OWN_LESS)
                keep = count[slot[near]] > 1
                yield less[keep], names[chosen[doc[near]]][keep], n[doc[near]][keep], slack[doc[near]][keep], role[keep]


def _rows(frame: DataFrame, s: Settings) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, data, offsets in passes(batch.column(0)):
                sets = Sets(data, offsets, s)
                names = sets.names()
                rows = np.unique(names, return_index=True)[1]
                rows = np.array([r for r in rows if sets.size[r] and names[r] not in seen], np.int64)
                seen.update(names[rows].tolist())
                for sig, node, size, slack, role in _segment_rows(sets, rows, names, s):
                    columns = (sig, node, packed(size, slack, role))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(c)) for c in columns], ["sig", "node", "packed"])

    # Most rows of the join: three columns are shuffled, not five.
    found = frame.select("_text").mapInArrow(work, "sig long, node long, packed long").repartition("sig")
    return found.select("sig", "node", *unpacked("packed"))


def packed(size: np.ndarray, slack: np.ndarray, role: np.ndarray) -> np.ndarray:
    """The three in 64 bits: a text of 2 GB has fewer than 2^30 words, and slack is from -2^28 to less than 2^30."""
    return size.astype(np.uint64) << np.uint64(34) | (slack + (1 << 28)).astype(np.uint64) << np.uint64(3) | role.astype(np.uint64)


def unpacked(column: str):
    """Columns size, slack and role of a packed one."""
    slack = F.shiftright(column, 3).bitwiseAND(F.lit((1 << 31) - 1)) - (1 << 28)
    role = F.col(column).bitwiseAND(F.lit(7))
    return [F.shiftrightunsigned(column, 34).cast("int").alias("size"), slack.cast("int").alias("slack"), role.cast("tinyint").alias("role")]


def _nodes(frame: DataFrame, s: Settings) -> DataFrame:
    """Key, text hash, size, set name and sketch of every row."""
    kind = frame.schema["_key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in passes(batch.column(1)):
                sets = Sets(data, offsets, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(rows.start, rows.stop - rows.start) for i in (0, 2)],
                        pa.array(sets.size.astype(np.int64)),
                        pa.array(signed(sets.names())),
                        pa.array(list(sets.sketches(s)), pa.list_(pa.int64())),
                    ],
                    ["_key", "digest", "size", "node", "sketch"],
                )

    digest = F.xxhash64("_text").alias("digest")
    return frame.select("_key", "_text", digest).mapInArrow(work, f"_key {kind}, digest long, size long, node long, sketch array<long>")


def _texts(frame: DataFrame, nodes: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """(node, text) of the asked nodes, one text each, told by its hash; a bit array spares most other texts the shuffle."""
    asked = stored(nodes.join(known, "node").select("node", "digest"))
    digest = F.xxhash64("_text")
    may = may_hold(asked.select("digest"), s.filter_bits)(digest)
    texts = frame.select("_text", digest.alias("digest")).where(may).groupBy("digest").agg(F.first("_text").alias("text"))
    return asked.join(texts, "digest").select("node", "text")


def _verified(frame: DataFrame, pairs: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose sets are similar enough."""
    pairs = stored(pairs.select("a", "b").distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(frame, ends, known, s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            one: dict[str, np.ndarray] = {}
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                sets = []
                for value in (x.as_py(), y.as_py()):
                    if value not in one:
                        if len(one) > 500:
                            one.clear()
                        data = np.frombuffer(value.encode(), np.uint8)
                        one[value] = Sets(data, np.array([0, len(data)]), s).token
                    sets.append(one[value])
                same = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * same >= s.percent * (len(sets[0]) + len(sets[1]) - same):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in "ab"], ["a", "b"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long"))


def _shared(rows: DataFrame, s: Settings) -> DataFrame:
    """Segment rows with a counterpart in another set.

    Where two sets have a hash, rows are summed up by ``partner``, the other set, if sizes
    allow a link; ``larger`` says that the set isn't the smaller one, so that it is the probe.
    Where more have it, a row keeps ``sig``, the least of the sets, and their number, the ``cost``.
    """
    # One order for all columns: the rows are sorted once, before the windows make them wide.
    order = Window.partitionBy("sig").orderBy("node")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index, probe = F.col("role").isin(*INDEXED), F.col("role").isin(*PROBES)
    seen = rows.select(
        "*",
        F.count("*").over(group).alias("cost"),
        F.min("node").over(group).alias("least"),
        F.max("node").over(group).alias("most"),
        F.min("role").over(group).alias("kind"),
        *[f(F.when(c, F.col("node"))).over(group).alias(n + m) for c, n in ((index, "i"), (probe, "p")) for f, m in ((F.min, "0"), (F.max, "1"))],
        F.lag("node").over(order).alias("previous"),
        (F.sum("size").over(group) - F.col("size")).alias("others"),
    )
    # Two shortened segments that are equal say nothing: they may differ in two tokens.
    met = (probe & ((F.col("i0") != F.col("node")) | (F.col("i1") != F.col("node")))) | (
        index & ((F.col("p0") != F.col("node")) | (F.col("p1") != F.col("node")))
    )
    found = seen.where((met & (F.col("kind") < OWN_LESS)) | (F.col("role") == THIN))
    found = found.where("previous IS NULL OR previous <> node")  # the same set from another task
    many = F.col("cost") > 2
    fit = F.least("size", "others") * 100 >= F.greatest("size", "others") * s.percent
    return found.where(many | fit | (F.col("role") == THIN)).groupBy(
        "node", "size", "slack", "role",
        F.when(~many, F.when(F.col("node") == F.col("least"), F.col("most")).otherwise(F.col("least"))).alias("partner"),
        F.when(~many, F.col("size") >= F.col("others")).alias("larger"),
        *[F.when(many, F.col(c)).alias(c) for c in ("sig", "least", "cost")],
    ).agg(F.count("*").alias("rows"))


def _lacking(rows: DataFrame) -> DataFrame:
    """Probes (``node``, ``lower``) short of units behind which no set of ``rows`` stands.

    ``lacking`` is what they must buy, ``cheap`` what the rows with one partner make up for.
    """
    # A segment with neighbourhood is two units, both lost if the whole segment is shared.
    lost = F.when(F.col("role").isin(OWN_FIRST, LOWER_FIRST), 2).otherwise(1) * F.col("rows")
    probes = _probes(rows).select("*", lost.alias("lost"))
    found = probes.groupBy("node", _lower().alias("lower")).agg(
        (F.sum("lost") - F.first("slack")).alias("lacking"), F.sum(F.when(F.col("sig").isNull(), _gain()).otherwise(0)).alias("cheap")
    )
    return found.where("lacking > 0")


def _probes(rows: DataFrame) -> DataFrame:
    """Rows of units that may bring up a set not larger than the row's."""
    return rows.where(F.col("role").isin(*PROBES) & (F.col("sig").isNotNull() | F.col("larger")))


def _lower():
    return F.col("role").isin(LOWER, LOWER_LESS, LOWER_FIRST)


def _gain():
    return F.when(F.col("role").isin(OWN_LESS, LOWER_LESS), 0).otherwise(F.col("rows"))


def _thin(nodes: DataFrame, shared: DataFrame, s: Settings) -> DataFrame:
    """Sets with too few segments that have tokens (one in 10^9) meet all sets of like size."""
    band = F.floor(F.log2(F.col("size") + 0.5))
    thin = shared.where(F.col("role") == THIN).select(F.col("node").alias("a"), F.col("size").alias("x")).distinct()
    thin = thin.select("a", "x", F.explode(F.array(*[F.floor(F.log2(F.col("x") + 0.5)) + k for k in (-1, 0, 1)])).alias("band"))
    others = nodes.where("size > 0").select(F.col("node").alias("b"), F.col("size").alias("y"), band.alias("band")).distinct()
    fit = F.least("x", "y") * 100 >= F.greatest("x", "y") * s.percent
    return thin.join(others, "band").where(fit & (F.col("a") != F.col("b"))).select("a", "b")


def _like(a: str, b: str, s: Settings):
    """Whether sizes and sketches of two sets allow the similarity."""
    low, high = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    words = [F.bit_count(F.get(f"{a}sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}sketch", F.lit(i)))) for i in range(s.sketch)]
    bits = sum(words[1:], words[0])
    return (high * s.percent <= low * 100) & (bits * (100 + s.percent) <= (low + high) * (100 - s.percent))


def _sides(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) with both sets' columns, named ``a_…`` and ``b_…``."""
    for x in "ab":
        pairs = pairs.join(info.select(*[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in info.columns]), x)
    return pairs


def _first_links(shared: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """Each set with those that it meets most, if either is a probe short of units."""
    meets = shared.where(F.col("role") != THIN).select("node", F.coalesce("partner", "least").alias("b"), "rows").where("node <> b")
    counts = meets.groupBy("node", "b").agg(F.sum("rows").alias("n"))
    # At most one set for each segment of the node.
    ranked = counts.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, s.first).alias("best"))
    best = ranked.select("node", F.explode("best.b").alias("b"))
    short = stored(_lacking(shared.where(F.col("role") != THIN)).select("node").distinct())
    pairs = stored(best.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())
    chosen = pairs.join(short.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(
        pairs.join(short.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    )
    return _sides(chosen.distinct(), known).where(_like("a_", "b_", s)).select("a", "b")


def _least(rows: DataFrame, s: Settings) -> DataFrame:
    """Each node's least units, in whole segments (``full``) and shortened ones (``near``)."""
    less = F.col("role").isin(OWN_LESS, LOWER_LESS)
    order = Window.partitionBy("node").orderBy("sig", "role")
    ranked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= s.least)
    return ranked.groupBy("node").agg(*[F.collect_list(F.when(c, F.col("sig"))).alias(n) for c, n in ((~less, "full"), (less, "near"))])


def _named(known: DataFrame, label: DataFrame) -> DataFrame:
    """The sets with their component so far, ``label``."""
    found = known.join(label.select(F.col("a").alias("node"), F.col("b").alias("_label")), "node", "left")
    return found.withColumn("label", F.coalesce("_label", "node")).drop("_label")


def _few(bought: DataFrame, index: DataFrame, known: DataFrame, s: Settings, turn: int) -> DataFrame:
    """Pairs (``a``, ``b``) of different components: the bought units of large groups with ``s.few`` sets of each.

    Which sets these are differs from unit to unit and from turn to turn, so a set meets many.
    """
    large = F.col("cost") > 8 * s.few
    order = Window.partitionBy("sig").orderBy(F.xxhash64("sig", "node", F.lit(turn)), "node")
    some = index.where(large).withColumn("n", F.row_number().over(order)).where(F.col("n") <= s.few)
    sides = [
        x.join(known, "node").select("sig", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "label", "size", "sketch")])
        for x, n in ((bought.where(large), "p"), (some, "i"))
    ]
    met = sides[0].join(sides[1], (sides[0]["sig"] == sides[1]["sig"]) & (F.col("p_label") != F.col("i_label")) & _like("p_", "i_", s))
    return met.select(F.greatest("p_node", "i_node").alias("a"), F.least("p_node", "i_node").alias("b")).distinct()


def _met(bought: DataFrame, index: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """Pairs (``a``, ``b``) of different components that share a bought unit, hardly any twice.

    Near copies share most of their units.  A pair is left to the least unit that the lists
    of both sets hold; the least of all shared units is never left to another, so none is lost.
    """
    sides = [
        x.join(known.join(_least(x, s), "node"), "node").select(
            "sig", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "label", "role", "size", "sketch", "full", "near")]
        )
        for x, n in ((bought, "p"), (index, "i"))
    ]
    less = F.col("p_role").isin(OWN_LESS, LOWER_LESS) & (F.col("i_role") == OWN_LESS)
    # Each probe finds all its partners, so of two sets of one size one need look.
    larger = F.struct("p_size", "p_node") > F.struct("i_size", "i_node")
    fit = (F.col("p_label") != F.col("i_label")) & larger & ~less & _like("p_", "i_", s)
    common = F.concat(
        F.array_intersect("p_full", F.concat("i_full", "i_near")), F.array_intersect("p_near", "i_full")
    )
    first = F.coalesce(F.array_min(common) >= sides[0]["sig"], F.lit(True))
    met = sides[0].join(sides[1], (sides[0]["sig"] == sides[1]["sig"]) & fit & first)
    return met.select(F.col("p_node").alias("a"), F.col("i_node").alias("b"))


def _units(shared: DataFrame, label: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The probes' cheapest ``H + 1`` units: pairs that one brings up alone, bought units and the sets behind them.

    A unit behind which only sets of the own component stand costs nothing: it can't bring
    up a new link.  That holds for the components of later on, too, as they only grow.
    """

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        found = rows.join(label.select(F.col("a").alias(node), F.col("b").alias("_label")), node, "left")
        return found.withColumn(name, F.coalesce("_label", node)).drop("_label")

    rows = labelled(shared.where(F.col("role") != THIN), "node", "label")
    pairs = labelled(rows.where("sig IS NULL"), "partner", "other").where("label <> other").drop("other")
    groups = rows.where("sig IS NOT NULL")
    mixed = groups.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    rows = stored(groups.join(mixed, "sig", "left_semi").select(*pairs.columns).unionByName(pairs))
    alive = stored(_lacking(rows))
    probes = _probes(rows).select("*", _lower().alias("lower"), _gain().alias("gain")).join(alive, ["node", "lower"])
    near = probes.where("sig IS NULL").select(F.col("node").alias("a"), F.col("partner").alias("b")).distinct()

    order = Window.partitionBy("node", "lower").orderBy("cost", "sig").rowsBetween(Window.unboundedPreceding, -1)
    bought = probes.where("sig IS NOT NULL").withColumn("before", F.coalesce(F.sum("gain").over(order), F.lit(0)) + F.col("cheap"))
    bought = stored(bought.where((F.col("gain") == 0) | (F.col("before") < F.col("lacking"))).select("sig", "node", "role", "cost"))
    index = rows.where(F.col("sig").isNotNull() & F.col("role").isin(*INDEXED)).select("sig", "node", "role", "cost")
    index = stored(index.join(bought.select("sig").distinct(), "sig", "left_semi"))
    return near, bought, index


def _candidates(near: DataFrame, bought: DataFrame, index: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """All pairs of different components that these units bring up."""
    fit = (F.col("a_label") != F.col("b_label")) & (F.col("a_size") >= F.col("b_size")) & _like("a_", "b_", s)
    near = _sides(near, known).where(fit).select("a", "b")
    met = _met(bought, index, known, s)
    return near.unionByName(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def join(frame: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` and ``component_id``, the least key reachable by links."""
    s = settings or Settings()
    batch_bytes(frame.sparkSession, SMALL_BATCH_BYTES)
    docs = frame.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    nodes = stored(_nodes(docs, s))  # one row a document, and small
    shared = stored(_shared(_rows(docs, s), s))
    known = stored(nodes.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "digest")]))
    # First the sets that each set meets most, then what is left between components.
    links = _verified(docs, _first_links(shared, known, s), known, s)
    label = components(links)
    near, bought, index = _units(shared, label, s)
    # The sets of large groups meet few others at a time until few are of different components: the last look at all is short then.
    for turn in range(s.turns):
        pairs = stored(_few(bought, index, _named(known, label), s, turn))
        if pairs.count() < s.enough:
            break
        label = components(label.unionByName(_verified(docs, pairs, known, s)))
    rest = _candidates(near, bought, index, _named(known, label), s)
    more = _verified(docs, rest.unionByName(_thin(nodes, shared, s)), known, s)
    label = components(label.unionByName(more))

    named = nodes.where("size > 0").groupBy("node").agg(F.min("_key").alias("least"))
    named = named.join(label.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("node", "component_id")
    filled = nodes.where("size > 0").join(named, "node").select("_key", "size", "component_id")
    empty = nodes.where("size = 0").select("_key", "size", F.col("_key").alias("component_id"))
    out = filled.unionByName(empty)
    return out.select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), "component_id")
