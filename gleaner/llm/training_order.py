"""Token ids in training order: fixed-stride records at slots of a keyed permutation.

Texts become token ids and an end token, cut into sequences of ``length`` ids.  Sequences are
numbered in the token table, which is written once: a task's rows in their order, tasks in
theirs, so one count a task gives every row its number and no row moves for it.  A keyed
Feistel network over the next even number of bits permutes the numbers; results outside the
range walk on along their cycle, so the permutation is exact for any number of sequences and
has an inverse.  Slots are range-partitioned, and each ``shard`` of consecutive slots is one
block of records of equal stride: record ``k`` starts at ``k * stride``, so a reader goes on at
any slot without an index.

A record is little-endian: document id (8 bytes, least value for null), part of the document
(4), number of ids (4), ids (``length`` times 2 or 4 bytes, filled up with the end id).

Defined cases: null and empty texts are a sequence of the end token alone; long texts have as
many parts as they need; repeated rows are sequences of their own; an empty table gives no
shards; only key and text are used, so other columns don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scan import mix, stored

NONE = -(1 << 63)
ROWS = 2048  # sequences of a message from Python, at least


@dataclass(frozen=True)
class Settings:
    length: int = 512  # ids of a sequence
    shard: int = 1024  # sequences of a shard
    key: int = 20_240_601
    rounds: int = 6
    width: int = 2  # bytes of an id

    @property
    def stride(self) -> int:
        return 16 + self.length * self.width

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Permutation:
    """A keyed bijection of ``range(count)``."""

    def __init__(self, count: int, s: Settings):
        self.count, half = count, max(1, (max(count - 1, 1).bit_length() + 1) // 2)
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = mix(np.arange(1, s.rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s.key))

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(values, np.uint64))
        outside = np.flatnonzero(out >= self.count)
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= self.count]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        def step(x):
            left, right = x >> self.half, x & self.mask
            for key in self.keys:
                left, right = right, left ^ (mix(right + key) & self.mask)
            return (left << self.half) | right

        return self._walk(numbers, step)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        def step(x):
            left, right = x >> self.half, x & self.mask
            for key in self.keys[::-1]:
                left, right = right ^ (mix(left + key) & self.mask), left
            return (left << self.half) | right

        return self._walk(slots, step)


def token_table(frame: DataFrame, path: str, pattern: str, key: str, text: str, s: Settings) -> DataFrame:
    """Written table (task, place, record) of all sequences, records in their final form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path, pattern)
        end, task, place = tool.n_vocab, TaskContext.get().partitionId(), 0
        if end >= 1 << (8 * s.width):
            raise ValueError(f"ids up to {end} don't fit {s.width} bytes")
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, place
            records = np.concatenate(held)
            starts = np.arange(rows + 1, dtype=np.int32) * s.stride
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, task, np.int32)),
                    pa.array(np.arange(place, place + rows)),
                    pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(starts), pa.py_buffer(records)]),
                ],
                ["task", "place", "record"],
            )
            place += rows
            held.clear()
            rows = 0
            return out

        for batch in batches:
            for key_of, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tool.encode_ordinary(value.as_py())
                ids.append(end)
                parts = -(-len(ids) // s.length)
                records = np.empty((parts, s.stride), np.uint8)
                filled = np.full(parts * s.length, end, s.kind)
                filled[: len(ids)] = ids
                head = np.zeros(parts, np.dtype([("d", "<i8"), ("p", "<i4"), ("n", "<i4")]))
                head["d"], head["p"] = NONE if key_of is None else key_of, np.arange(parts)
                head["n"] = np.minimum(len(ids) - np.arange(parts) * s.length, s.length)
                records[:, :16], records[:, 16:] = head.view(np.uint8).reshape(parts, 16), filled.view(np.uint8).reshape(parts, -1)
                held.append(records)
                rows += parts
                # A message to Spark costs more than a short document: some 2 MB go at once.
                if rows >= ROWS:
                    yield flush()
        if rows:
            yield flush()

    docs = frame.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return stored(docs.mapInArrow(work, "task int, place long, record binary"))


def shards(tokens: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(shard, first_slot, n_sequences, doc_ids, payload) of a token table, one row a shard."""
    s = settings or Settings()
    # One row a task of the job that wrote the table.
    counts = sorted((r["task"], r["n"]) for r in tokens.groupBy("task").agg(F.count("*").alias("n")).collect())
    offset, total = {}, 0
    for task, n in counts:
        offset[task], total = total, total + n
    order = Permutation(total, s)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, number = (batch.column(i).to_numpy() for i in range(2))
            slots = order.slots(np.array([offset[t] for t in task.tolist()], np.int64) + number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // s.shard), pa.array((slots % s.shard).astype(np.int32)), batch.column(2)], ["shard", "row", "record"]
            )

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("row").to_numpy())
        records = [r.as_py() for r in group.column("record").take(pa.array(order))]
        documents = np.array([int.from_bytes(r[:8], "little", signed=True) for r in records], np.int64)
        shard = group.column("shard")[0].as_py()
        ids = pa.array([documents], pa.list_(pa.int64()))
        return pa.table(
            [pa.array([shard]), pa.array([shard * s.shard]), pa.array([len(records)]), ids, pa.array([b"".join(records)], pa.binary())],
            ["shard", "first_slot", "n_sequences", "doc_ids", "payload"],
        )

    placed = tokens.select("task", "place", "record").mapInArrow(place, "shard long, row int, record binary")
    schema = "shard long, first_slot long, n_sequences long, doc_ids array<long>, payload binary"
    return placed.repartitionByRange("shard").groupBy("shard").applyInArrow(pack, schema)


def sequences(shard_table: DataFrame, from_slot: int = 0, settings: Settings | None = None) -> DataFrame:
    """(slot, doc_id, part, ids) of written shards from a slot on; earlier shards aren't read."""
    s = settings or Settings()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(payload.as_buffer(), np.uint8).reshape(-1, s.stride)
                head = np.ascontiguousarray(data[:, :16]).view(np.dtype([("d", "<i8"), ("p", "<i4"), ("n", "<i4")]))[:, 0]
                ids = np.ascontiguousarray(data[:, 16:]).view(s.kind)
                slots = first + np.arange(len(data))
                used = np.flatnonzero(slots >= from_slot)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots[used]),
                        pa.array(head["d"][used], mask=head["d"][used] == NONE),
                        pa.array(head["p"][used]),
                        pa.array([ids[i, : head["n"][i]].astype(np.int32) for i in used], pa.list_(pa.int32())),
                    ],
                    ["slot", "doc_id", "part", "ids"],
                )

    later = shard_table.where(F.col("first_slot") + F.col("n_sequences") > from_slot).select("first_slot", "payload")
    return later.mapInArrow(work, "slot long, doc_id long, part int, ids array<int>")
