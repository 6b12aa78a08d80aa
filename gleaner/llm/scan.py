"""Helpers the operators share: Arrow text columns as byte runs, hashed with numpy inside tasks.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; these bytes never
occur inside a UTF-8 character, so bytes give the same words as code points.  Hashes are
64 bits wide and depend on bytes only, never on the partition or the process.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir, tune

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Bytes of text that one numpy pass works on, whose arrays are some 100 times as large; a longer document is a pass of its own.
PASS_BYTES = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, dtype=np.uint8)
_WORD[list(SPACES)] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (shifts and multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """1, base, base^2 … modulo 2^64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Runs:
    """Words of some texts: byte ranges, hashes, and the place of each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    kind: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, lower: bool = False, classes: np.ndarray = _WORD) -> Runs:
    """Maximal runs of one byte class; class 0 separates."""
    n, texts = len(data), len(offsets) - 1
    empty = np.zeros(0, np.int64)
    if not n:
        return Runs(data, empty, empty, np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64), np.zeros(0, np.uint8))
    kind = classes[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < n]] = True
    begin = np.flatnonzero(edge)
    length = np.diff(begin, append=n)
    used = kind[begin] > 0
    place = np.arange(n, dtype=np.int64) - np.repeat(begin, length)
    part = _VALUES[lower][data]
    part *= powers(int(place.max()) + 1)[place]
    hashed = mix(np.add.reduceat(part, begin) + length.astype(np.uint64) * _PRIME)[used]
    start, length = begin[used], length[used]
    return Runs(data, start, start + length, hashed, np.searchsorted(start, offsets), kind[start])


def passes(column, size: int = PASS_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Split a column into row ranges of about ``size`` bytes: (rows, bytes, offsets)."""
    data, offsets = text_bytes(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, rows)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values (over text borders too: mask those)."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, p in enumerate(powers(size, 0xDA942042E4DD58B5)):
        total += hashed[k : k + n] * p
    return mix(total + np.uint64(size))


def complete(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that lie inside one text, and each text's number of windows."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    base = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return base + np.arange(int(count.sum())), count


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# Bytes of one Arrow batch, so that long texts don't add up in a task.
BATCH_BYTES = 16 << 20
# Where an executor's memory is needed for sorts beside the texts.
SMALL_BATCH_BYTES = 4 << 20


def batch_bytes(spark: SparkSession, size: int) -> None:
    """Size of the Arrow batches of what is planned from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on."""
    batch_bytes(spark, BATCH_BYTES)
    return tune(spark)


def stored(frame: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it: later steps start from there.

    Executors may be lost afterwards.  The files are compressed, which checkpoints aren't.
    """
    place = f"{ensure_checkpoint_dir(frame.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_sample(frame: DataFrame, group: str, key: str, rows: int) -> DataFrame:
    """At most ``rows`` keys of each group, by least hash: (``key``, ``group``), nulls left out.

    The group limit is applied before the shuffle, so each task sends at most ``rows`` keys
    of a group, and the result has a size bound: rows x groups.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(7)), key)
    found = frame.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, group).distinct()
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).drop("_n")


def hashed_bits(values: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """Bit numbers of 64-bit values in an array of ``bits`` bits, a power of two."""
    for k in range(probes):
        yield (mix(values + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


def holds(array: np.ndarray, values: np.ndarray, probes: int) -> np.ndarray:
    """Whether values may be in a bit array; never false for one that is."""
    out = np.ones(len(values), bool)
    for at in hashed_bits(values, len(array) * 8, probes):
        out &= (array[at >> 3] & (128 >> (at & 7)).astype(np.uint8)) > 0
    return out


BIT_PARTS = 64
_BITS = pa.schema([("part", pa.int32()), ("bits", pa.binary()), ("again", pa.binary())])


def bit_rows(values: np.ndarray, bits: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows ``part, bits, again`` of one batch's values, for ``bit_arrays``."""
    seen, count = np.unique(values.astype(np.uint64, copy=False), return_counts=True)
    again, width = count > 1, bits // BIT_PARTS
    for at in hashed_bits(seen, bits, probes):
        part = at // width
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(BIT_PARTS + 1))
        used = [(i, order[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        if used:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in used], pa.int32()),
                    pa.array([(at[o] % width).astype(np.uint32).tobytes() for _, o in used], pa.binary()),
                    pa.array([again[o].tobytes() for _, o in used], pa.binary()),
                ],
                schema=_BITS,
            )


def bit_arrays(rows: DataFrame, bits: int, twice: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two bit arrays of a fixed size: values seen, and values seen more than once.

    Each range of bits is filled in one task; the driver gets ``2 * bits`` bits whatever
    the number of values, so the result may be broadcast.  It only ever says "not there" for
    sure: a fuller array saves less work and changes no result.  Without ``twice`` the second
    array isn't sent and stays empty.
    """
    width = bits // BIT_PARTS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, data, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                once, twice = arrays.setdefault(part, (np.zeros(width, bool), np.zeros(width, bool)))
                at, more = np.frombuffer(data, np.uint32), np.frombuffer(again, bool)
                first = np.zeros(len(at), bool)
                first[np.unique(at, return_index=True)[1]] = True
                twice[at[once[at] | more | ~first]] = True
                once[at] = True
        for part, (once, twice) in arrays.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *[pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (once, twice)]],
                schema=_BITS,
            )

    names = ("bits", "again") if twice else ("bits",)
    out = [np.zeros(bits // 8 if name in names else 0, np.uint8) for name in ("bits", "again")]
    for row in rows.repartition(BIT_PARTS, "part").mapInArrow(fold, "part int, bits binary, again binary").select("part", *names).collect():
        place = slice(row["part"] * width // 8, (row["part"] + 1) * width // 8)
        for array, name in zip(out, names, strict=False):
            array[place] = np.frombuffer(row[name], np.uint8)
    return out[0], out[1]


def may_hold(values: DataFrame, bits: int = 1 << 26, probes: int = 2) -> Callable[[Column], Column]:
    """A test whether a 64-bit value may be among those of ``values``, a table of one column.

    It never denies a value that is there, and its bit array has a fixed size.  Rows that it denies
    need no join; the others are for an exact one.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bit_rows(batch.column(0).to_numpy().view(np.uint64), bits, probes)

    seen = bit_arrays(values.mapInArrow(fill, "part int, bits binary, again binary"), bits, twice=False)[0]
    shared = values.sparkSession.sparkContext.broadcast(seen)

    @F.arrow_udf("boolean")
    def test(value: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, value.to_numpy(zero_copy_only=False).view(np.uint64), probes))

    return test
