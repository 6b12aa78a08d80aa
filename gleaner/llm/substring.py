"""Exact removal of repeated word sequences by fixed-block anchors.

Any window of ``size`` words contains a whole aligned block of ``block = (size + 1) // 2``
words, wherever it starts.  So if a window occurs twice, an aligned block of either
occurrence is met by a rolling window over the other.  The aligned blocks of all texts are
the index; every rolling window probes it; stretches around hits are extended to all their
windows of ``size`` words, and those that a count over all texts finds twice are repeats.
Overlapping repeated windows join to maximal repeats, whose words go.

Plan: (1) the index is folded into two bit arrays of a fixed size (a block seen, a block seen
again), built range by range in tasks and broadcast: their size is a parameter and doesn't
grow with the data.  A fuller array lets more windows through to step 2, so that it costs
shuffle, never results.  (2) Windows near hits go by their 96-bit hash to a count, equal
windows of one Arrow batch in one row, so that a passage all documents share makes one row
a batch.  (3) Starts of repeats meet the texts by a 64-bit hash of key and text; rows equal in
both lose the same words.

Defined cases: null text has no words; a text under ``size`` words loses nothing; repeats
within one text count; equal rows, also with a null key, are separate documents whose windows
are repeats of each other; an empty table gives an empty table; only the named columns are
used, so others and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scan import SMALL_BATCH_BYTES, Runs, batch_bytes, bit_arrays, bit_rows, complete, holds, may_hold, mix, passes, runs, signed, stored, windows


@dataclass(frozen=True)
class Settings:
    size: int = 35
    filter_bits: int = 1 << 27  # of each bit array; a power of two
    probes: int = 3

    @property
    def block(self) -> int:
        return (self.size + 1) // 2


def _blocks(words: Runs, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling block hashes of all texts, their first word, and whether they are aligned."""
    places, _ = complete(words.first, block)
    hashed = windows(words.hash, block)[places]
    owner = np.searchsorted(words.first, places, side="right") - 1
    return hashed, places, (places - words.first[owner]) % block == 0


def index_filter(frame: DataFrame, text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bit arrays of the aligned blocks seen, and seen more than once, of all texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, data, offsets in passes(batch.column(0)):
                hashed, _, aligned = _blocks(runs(data, offsets), settings.block)
                found.append(hashed[aligned])
            yield from bit_rows(np.concatenate(found), settings.filter_bits, settings.probes)

    return bit_arrays(frame.select(text).mapInArrow(emit, "part int, bits binary, again binary"), settings.filter_bits)


def _hits(hashed: np.ndarray, aligned: np.ndarray, arrays, settings: Settings) -> np.ndarray:
    """Windows that may equal an aligned block elsewhere; an aligned one always equals itself."""
    out = np.zeros(len(hashed), bool)
    for array, which in zip(arrays, (~aligned, aligned), strict=True):
        out[which] = holds(array, hashed[which], settings.probes)
    return out


def _candidates(words: Runs, arrays, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First words of the ``size``-word windows with a hit inside, and their 128-bit hashes."""
    size, block = settings.size, settings.block
    hashed, places, aligned = _blocks(words, block)
    full = np.zeros(len(words.hash) + 1, np.int64)
    full[places[_hits(hashed, aligned, arrays, settings)] + 1] = 1
    seen = np.cumsum(full)
    by_place = np.zeros(len(words.hash), np.uint64)
    by_place[places] = hashed
    starts, _ = complete(words.first, size)
    starts = starts[seen[starts + size - block + 1] > seen[starts]]
    # Two blocks cover a window, the second one ending with it.
    pair = np.stack([by_place[starts], by_place[starts + size - block]])
    return starts, pair


def repeats(frame: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(``_id``, ``_at``): the word places where a window starts that also starts elsewhere.

    ``key`` is a column of longs.
    """
    arrays = frame.sparkSession.sparkContext.broadcast(index_filter(frame, text, settings))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for rows, data, offsets in passes(batch.column(1)):
                words = runs(data, offsets)
                starts, pair = _candidates(words, arrays.value, settings)
                owner = np.searchsorted(words.first, starts, side="right") - 1
                parts.append((pair[0], mix(pair[0] * np.uint64(3) + pair[1]), keys[rows][owner], starts - words.first[owner]))
            if not parts:
                continue
            first, second, ids, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            second >>= np.uint64(32)
            order = np.lexsort((second, first))
            same = np.ones(len(order), bool)
            same[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order].view(np.int64)) != 0)
            head = np.flatnonzero(same)
            many = np.diff(head, append=len(order)) > 1
            # One row stands for equal windows of the batch; the others are repeats already.
            known = np.zeros(len(order), bool)
            known[order] = ~same
            lead = np.zeros(len(order), np.int64)
            lead[order[head]] = np.where(many, 2, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(first)),
                    pa.array((second.view(np.int64) << 32) | at),
                    pa.array(np.where(known, 0, lead).astype(np.int8)),
                    pa.array(ids),
                ],
                ["h", "rest", "n", "_id"],
            )

    rows = frame.select(key, text).mapInArrow(emit, "h long, rest long, n tinyint, _id long")
    place = (F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("_at")
    same = Window.partitionBy("h", F.shiftrightunsigned("rest", 32))
    counted = rows.where("n > 0").withColumn("total", F.sum("n").over(same)).where("total > 1")
    return counted.select("_id", place).unionByName(rows.where("n = 0").select("_id", place))


def _starts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(``_id``, ``_starts``): distinct starts, so that rows equal in key and text don't add up."""
    return repeats(docs, "_id", "_text", settings).groupBy("_id").agg(F.collect_set("_at").alias("_starts"))


def _covered(starts, words: int, size: int) -> np.ndarray:
    change = np.zeros(words + 1, np.int64)
    starts = np.unique(np.asarray(starts, np.int64))
    change[starts] += 1
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:words]) > 0


def remove_repeats(
    frame: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), settings: Settings | None = None
) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_removed`` and ``kept_text`` (words joined by spaces).

    Where nothing is removed, ``kept_text`` still has single spaces between its words.
    """
    settings = settings or Settings()
    # A task holds some 70 bytes a word of its batch where most windows are candidates.
    batch_bytes(frame.sparkSession, SMALL_BATCH_BYTES)
    docs = frame.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("_id"),
    )
    # Texts without a repeated window, most of them, go straight on; the others meet their starts.
    starts = stored(_starts(docs, settings))
    may = may_hold(starts.select("_id"))("_id")
    plain = docs.where(~may).withColumn("_starts", F.lit(None).cast(starts.schema["_starts"].dataType))
    joined = docs.where(may).join(starts, "_id", "left").select(plain.columns).unionByName(plain).drop("_id")
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[: len(keep)]]
    schema = ", ".join([*head, "n_words long, n_removed long, kept_text string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for value, places in zip(batch.column("_text"), batch.column("_starts"), strict=True):
                own = value.as_py().encode().split()
                words.append(len(own))
                if places.is_valid:
                    gone = _covered(places.values.to_numpy(), len(own), settings.size)
                    removed.append(int(gone.sum()))
                    own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*[f"_{i}" for i in range(len(keep))], "n_words", "n_removed", "kept_text"],
            )

    out = joined.mapInArrow(work, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept_text")
