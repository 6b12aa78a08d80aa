"""Ranked lexical search: exact inner products of sparse vectors through ball trees.

A document's vector holds, for each term of the query set, an integer: the term's weight times
its saturated frequency.  A query is the set of its terms, so a score is an inner product.
Each block of documents becomes a ball tree: a node knows the centroid of its documents
and a radius; with coordinates scaled by the root of the term's weight, no document of a
node scores above ``<q, centroid> + |q| * radius`` (Cauchy-Schwarz).  A query opens nodes from the highest
bound down, scores leaves in 64-bit integers, and ends when the best bound left is below its k-th
score so far; that score is carried through all blocks of a task.  Bounds are doubles made larger
by ``MARGIN``, which is far above the rounding of their sums, so no document is lost.

Spark does the rest: one pass turns texts into sparse rows of the query set's terms (written,
about a tenth of the texts), one sums term counts, one searches blocks, and the best ``k`` of
each task meet in a window with a group limit.  The query set is taken in blocks of a bounded size,
each against all rows.

Defined cases: terms are told apart by 64-bit hashes; a null or term-free text is no document
of the count and is found by nothing; a null, empty or term-free item finds nothing; equal rows of
items are one item, other rows with the same id are items of their own, ranked apart; equal
documents each have a place; ties go by ascending key, null keys first; texts of any length
count whole; no documents or no items give no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scan import passes, runs, stored

# One class of bytes: ASCII letters and digits, and all bytes of other characters.
_TERM = np.zeros(256, np.uint8)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = 1
# Share and sum by which a bound is raised: sums of 10^6 doubles are exact to 2^-53 * 10^6 < 2e-10.
MARGIN = 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 50
    block_bytes: int = 1 << 20  # item text of one pass
    leaf: int = 64  # documents of a leaf
    block: int = 8192  # documents of a tree at most
    saturation: int = 20
    length_share: int = 50  # percent


def terms(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the terms of some rows and the place of each row's first: A-Z in lower case."""
    for _, data, offsets in passes(column):
        found = runs(data, offsets, lower=True, classes=_TERM)
        yield found.hash, found.first


def vocabulary(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct term hashes of some texts in order, and each text's distinct places in them."""
    parts = [np.unique(h[a:b]) for h, first in terms(pa.array(texts, pa.string())) for a, b in zip(first, first[1:], strict=False)]
    known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return known, [np.searchsorted(known, p) for p in parts]


SPARSE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("term", pa.binary()), ("tf", pa.binary())])


def sparse(frame: DataFrame, key: str, text: str, known) -> DataFrame:
    """Per row its key, number of terms, and the known terms with their counts as int32 and int64 runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            at = 0
            for hashed, first in terms(batch.column(1)):
                place = np.searchsorted(words, hashed)
                hit = np.zeros(len(hashed), bool)
                inside = place < len(words)
                hit[inside] = words[place[inside]] == hashed[inside]
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
                pairs, count = np.unique(owner * max(len(words), 1) + place[hit], return_counts=True)
                rows, term = np.divmod(pairs, max(len(words), 1))
                edge = np.searchsorted(rows, np.arange(len(first)))
                term, count = term.astype(np.int32), count.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(first) - 1),
                        pa.array(np.diff(first), pa.int64()),
                        *[pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary()) for x in (term, count)],
                    ],
                    schema=SPARSE,
                )
                at += len(first) - 1

    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(work, "key long, n long, term binary, tf binary"))


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Number of documents of each known term: one array of the query set's size a task, summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(data, np.int32), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["term", "n"])

    counts = rows.select("term").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in counts.collect():  # one row a term of the query set's block
        out[row["term"]] = row["n"]
    return out


class Tree:
    """Ball tree over sparse integer vectors in CSR form (``first``, ``term``, ``value``)."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray, leaf: int):
        self.size = len(scale)
        self.first, self.term, self.value, self.scaled = first, term, value, value / scale[term]
        self.order = np.arange(len(first) - 1)
        self.span: list[tuple[int, int]] = []
        self.child: list[int] = []  # the second of two children; the first follows its parent
        self.radius: list[float] = []
        self._node, self._dim, self._mean = [], [], []
        self._grow(0, len(self.order), leaf)
        node, dim, mean = (np.concatenate(x) if x else np.zeros(0) for x in (self._node, self._dim, self._mean))
        sort = np.argsort(dim, kind="stable")
        self.edge = np.searchsorted(dim[sort], np.arange(self.size + 1))
        self.node, self.mean = node[sort].astype(np.int64), mean[sort]
        self.radius = np.array(self.radius)
        self._lay_out()

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and where each row's entries begin."""
        count = self.first[rows + 1] - self.first[rows]
        edge = np.concatenate([[0], np.cumsum(count)])
        return np.arange(edge[-1]) - np.repeat(edge[:-1] - self.first[rows], count), edge

    def _grow(self, low: int, high: int, leaf: int) -> None:
        work = [(low, high, -1)]
        while work:
            low, high, parent = work.pop()
            me = len(self.span)
            if parent >= 0:
                self.child[parent] = me
            rows = self.order[low:high]
            at, edge = self._flat(rows)
            dim, x = self.term[at], self.scaled[at]
            centre = np.bincount(dim, weights=x, minlength=self.size) / (high - low)
            owner = np.repeat(np.arange(high - low), np.diff(edge))
            norm = np.bincount(owner, weights=x * x, minlength=high - low)
            square = norm - 2 * np.bincount(owner, weights=x * centre[dim], minlength=high - low) + centre @ centre
            # The difference may cancel: raise it by a share of what it came from.
            far = float(np.maximum(square, 0).max() + MARGIN * (norm.max() + centre @ centre))
            self.span.append((low, high))
            self.child.append(0)
            self.radius.append(math.sqrt(far) * (1 + MARGIN))
            used = np.flatnonzero(centre)
            self._node.append(np.full(len(used), me))
            self._dim.append(used)
            self._mean.append(centre[used])
            if high - low <= leaf:
                continue
            # Halves by the projection on the line through two far rows.
            one = self._dense(rows[int(square.argmax())])
            away = np.bincount(owner, weights=x * one[dim], minlength=high - low)
            two = self._dense(rows[int((norm - 2 * away).argmax())])
            along = np.bincount(owner, weights=x * (one - two)[dim], minlength=high - low)
            middle = (high - low) // 2
            self.order[low:high] = rows[np.argpartition(along, middle)]
            work.append((low + middle, high, me))
            work.append((low, low + middle, -1))

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.size)
        a, b = self.first[row], self.first[row + 1]
        out[self.term[a:b]] = self.scaled[a:b]
        return out

    def _lay_out(self) -> None:
        at, edge = self._flat(self.order)
        self.first, self.term, self.value = edge, self.term[at], self.value[at]

    def bounds(self, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """No document of a node scores more than this."""
        total = np.zeros(len(self.span))
        for t in query:
            a, b = self.edge[t], self.edge[t + 1]
            total[self.node[a:b]] += weight[t] * self.mean[a:b]
        length = math.sqrt(float((weight[query] ** 2).sum()))
        return (total + length * self.radius) * (1 + MARGIN) + 1

    def search(self, query: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Offer every document that may be among the best; returns the number of documents scored."""
        bound = self.bounds(query, weight)
        chosen = np.zeros(self.size, np.int64)
        chosen[query] = 1
        heap, scored = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= best.least:
            top, node = heapq.heappop(heap)
            if self.child[node]:
                for below in (node + 1, self.child[node]):
                    heapq.heappush(heap, (max(top, -bound[below]), below))
                continue
            low, high = self.span[node]
            a, b = self.first[low], self.first[high]
            sums = np.zeros(b - a + 1, np.int64)
            np.cumsum(self.value[a:b] * chosen[self.term[a:b]], out=sums[1:])
            edge = self.first[low : high + 1] - a
            best.offer(self.order[low:high], sums[edge[1:]] - sums[edge[:-1]])
            scored += high - low
        return scored


class Best:
    """The ``k`` highest scores above 0 so far, ties by least key, nulls first."""

    def __init__(self, k: int):
        self.k, self.least, self.rows, self.keys = k, 1, [], None

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        keep = np.flatnonzero(scores >= self.least)
        if not len(keep):
            return
        keys = self.keys
        self.rows += [(-int(s), *keys(r)) for r, s in zip(rows[keep], scores[keep], strict=True)]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to about ``size`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(batch.slice(at, size))
            if sum(b.num_rows for b in held) >= size:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


FOUND = pa.schema([("item", pa.int32()), ("key", pa.int64()), ("score", pa.int64())])


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((2N + 2) / (2df + 1)))`` of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def search_block(rows: DataFrame, items: list[np.ndarray], frequency: np.ndarray, documents: int, total: int, s: Settings) -> DataFrame:
    """The best ``k`` of each task: ``item, key, score``."""
    weight = weights(documents, frequency)
    root = np.sqrt(np.maximum(weight, 1).astype(float))
    shared = rows.sparkSession.sparkContext.broadcast((items, weight, root))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, root = shared.value
        best = [Best(s.k) for _ in items]
        for batch in blocks(batches, s.block):
            length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = batch.column(2).to_pylist()
            term = np.frombuffer(b"".join(parts), np.int32).astype(np.int64)
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            count = np.array([len(p) // 4 for p in parts], np.int64)
            m = 100 - s.length_share + (s.length_share * length * documents) // total
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + s.saturation * np.repeat(m, count)))
            keep = value > 0
            owner = np.repeat(np.arange(len(count)), count)[keep]
            count = np.bincount(owner, minlength=len(count))
            some = np.flatnonzero(count)  # rows without a term of weight score 0
            if not len(some):
                continue
            first = np.concatenate([[0], np.cumsum(count[some])])
            tree = Tree(first, term[keep], value[keep], root, s.leaf)
            keys = [(x is not None, x or 0) for x in batch.column(0).take(pa.array(some)).to_pylist()]
            for query, held in zip(items, best, strict=True):
                held.keys = keys.__getitem__
                tree.search(query, root, held)
        out = [(i, key if there else None, -score) for i, held in enumerate(best) for score, there, key in held.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return rows.mapInArrow(work, "item int, key long, score long")


def search(
    frame: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """``item_id, rank, key, score`` of each item's ``k`` best documents; keys are longs."""
    s = settings or Settings()
    spark = frame.sparkSession
    items = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // s.block_bytes)
    kind = items.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, `{key}` long, score long")
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()  # about block_bytes
        known, queries = vocabulary([r["text"] for r in chosen])
        rows = sparse(frame, key, text, spark.sparkContext.broadcast(known))
        whole = rows.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        if not whole["documents"]:
            continue
        found = search_block(rows, queries, frequencies(rows, len(known)), whole["documents"], whole["total"], s)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"))
        ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k))
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(chosen)], f"item int, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", F.col("key").alias(key), "score"))
    return out
