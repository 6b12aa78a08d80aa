"""Benchmark passages in documents, found by pigeonhole edit matching.

A test item of ``n`` characters has an error budget of ``k = floor(rate * n)`` edits and is cut
into ``k + 1`` pieces.  A stretch of text within ``k`` edits of the item holds at least one
piece unchanged, so exact piece hits (one automaton for all pieces) give all candidates, and
Myers' bit-parallel distance decides each of them.  Items and documents are compared in lower
case with single spaces for white space.

The items are a stated query set: they are taken in blocks of a bounded size, each block
against all rows in one pass without a shuffle.

Defined cases: a null, empty or blank item matches nothing, as does a null or empty document;
an item too short for an edit must occur exactly; texts of any length are searched whole;
several places of one item give one entry with its least distance; repeated rows each get
their own result, repeated items with different ids one entry each, equal rows of items one;
no items or no documents give no entries; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    rate: float = 0.08  # edits per character of an item
    block_bytes: int = 4 << 20  # item text of one pass


def normal(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().split()).decode()


def cuts(length: int, rate: float) -> list[tuple[int, int]]:
    """Borders of the ``k + 1`` pieces, as even as can be."""
    parts = int(rate * length) + 1
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, text: str, budget: int):
        self.size, self.budget = len(text), budget
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def distance(self, text: str) -> int:
        """Least edit distance of the item to any stretch of ``text``."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best = full, 0, self.size, self.size
        masks = self.masks
        for c in text:
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                best = min(best, score)
            up = (up << 1) & full
            down = (down << 1) & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return best


class Matcher:
    def __init__(self, items: list[tuple], rate: float):
        self.ids, self.patterns = [], []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            text = normal(text)
            if not text:
                continue
            borders = cuts(len(text), rate)
            for start, end in borders:
                # with the shift from the piece's last character to the item's first
                pieces[text[start:end]].append((len(self.ids), end - 1))
            self.ids.append(item)
            self.patterns.append(Pattern(text, len(borders) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        if pieces:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[dict]:
        text = normal(text)
        if not text or not self.ids:
            return []
        places: dict[int, list[int]] = defaultdict(list)
        for end, owners in self.automaton.iter(text):
            for number, shift in owners:
                places[number].append(end - shift)
        found = []
        for number, starts in places.items():
            pattern, best = self.patterns[number], None
            for low, high in self._stretches(starts, pattern):
                distance = pattern.distance(text[max(low, 0) : high])
                best = distance if best is None else min(best, distance)
            if best <= pattern.budget:
                found.append({"item_id": self.ids[number], "distance": best})
        return sorted(found, key=lambda x: (x["distance"], x["item_id"] is None, x["item_id"]))

    @staticmethod
    def _stretches(starts: list[int], pattern: Pattern) -> list[list[int]]:
        """Joined text ranges in which an occurrence behind one of the hits must lie."""
        out: list[list[int]] = []
        for start in sorted(set(starts)):
            low, high = start - pattern.budget, start + pattern.size + pattern.budget
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return out


def match(
    frame: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), settings: Settings | None = None,
) -> DataFrame:
    """``keep`` columns and ``leaks``: (item_id, distance) of every item within its budget."""
    settings = settings or Settings()
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // settings.block_bytes)
    leaks = f"array<struct<item_id: {kind}, distance: int>>"
    out = frame.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)],
        F.col(text).alias("_text"),
        F.array().cast(leaks).alias("leaks"),
    )
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        shared = frame.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Matcher(shared.value, settings.rate)
            for batch in batches:
                column = [
                    [*(old or []), *found(value.as_py())]
                    for value, old in zip(batch.column("_text"), batch.column("leaks").to_pylist(), strict=True)
                ]
                leaks = pa.array(column, batch.schema.field("leaks").type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], leaks], batch.schema.names)

        out = out.mapInArrow(work, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "leaks")
