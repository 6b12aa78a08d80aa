"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding.  A token ends the
prefix when the rest of the prefix ends in a token it is *compatible* with: merging the
bytes of both gives back the same two tokens.  So the table ``last[i]`` is filled from
left to right, a text grows by filling on, and after an edit only the prefixes from the
edit on are looked at until the table falls in step again.

Defined cases: null text encodes as an empty text (no ids, the digests of empty input);
empty text has no ids; any length is worked through in one pass; rows are independent, so
repeated rows and ties give equal results; extra columns are dropped by ``encode`` unless
named in ``keep``; an empty table gives an empty table.  Bytes that are no token and ids
outside the vocabulary raise an error, as neither can come from a complete vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Pieces, stretches between spaces, and pairs of tokens that a worker remembers; twice as many at most.
MEMORY = 300_000
# Where other steps of the same executor have left their memory in use: a word may be worked out again.
SMALL_MEMORY = 50_000
NEVER = 1 << 60


class Recent(dict):
    """Values by key, worked out by ``make`` when asked for.

    Once it holds ``limit`` keys they become the old ones, from which those asked for again
    are taken over.  So words of every text stay, and words that occur once go.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make = make
        self.limit = limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Ranks of a byte-level BPE and the compatibility of token pairs.

    While a token is built, its first and its last part grow; ``heads`` and ``tails`` list
    these parts from one byte up, each with the rank of the merge that absorbs it.
    """

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.heads: dict[bytes, tuple] = {}
        self.tails: dict[bytes, tuple] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = self.merge(token, rank)
            if len(parts) == 1:
                self.heads[token] = self.tails[token] = ((token, NEVER),)
            elif len(parts) == 2 and parts[0] in self.heads and parts[1] in self.heads:
                head, tail = self.heads[parts[0]], self.tails[parts[1]]
                self.heads[token] = (*head[:-1], (parts[0], rank), (token, NEVER))
                self.tails[token] = (*tail[:-1], (parts[1], rank), (token, NEVER))
            # else no merges lead to this token: it only ever stands for a whole piece
        # Finds the tokens that end at each byte, the longest first.
        self.endings = ahocorasick.Automaton()
        for token in self.heads:
            self.endings.add_word(token.decode("latin-1"), (ranks[token], len(token)))
        self.endings.make_automaton()
        self.pairs = Recent(lambda key: self.compatible(self.tokens[key >> 32], self.tokens[key & 0xFFFFFFFF]), memory)

    def merge(self, data: bytes, below: int) -> list[bytes]:
        """Merge the lowest-ranked neighbours first, by merges of a rank under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether no merge across the border comes before the parts beside it are absorbed."""
        tails, heads, rank_of = self.tails[left], self.heads[right], self.ranks.get
        i = j = 0
        while True:
            a, a_gone = tails[i]
            b, b_gone = heads[j]
            across = rank_of(a + b, NEVER)
            # Equal ranks are merged from the left: the left part's own merge comes first.
            if across < a_gone and across <= b_gone and across < NEVER:
                return False
            if a_gone == b_gone == NEVER:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1


class Prefixes:
    """The encoding of a growing or edited byte string; the token ``last[i]`` ends prefix ``i + 1``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = data
        self.last: list[int] = []
        self._fill(len(data))

    def _fill(self, to: int) -> None:
        """Extend ``last`` to the prefix of length ``to``: longest token first, one is valid."""
        last, vocabulary = self.last, self.vocabulary
        pairs, done = vocabulary.pairs, len(last)
        base = max(0, done + 1 - vocabulary.longest)  # no token that ends behind ``done`` starts earlier
        for end, (rank, size) in vocabulary.endings.iter(self.data[base:to].decode("latin-1")):
            end += base
            if end < done:
                continue
            if end > done:
                break
            if size <= end and not pairs[last[end - size] << 32 | rank]:
                continue
            last.append(rank)
            done += 1
        if done < to:
            raise ValueError(f"no token ends {self.data[: done + 1]!r}")

    def append(self, data: bytes) -> Prefixes:
        self.data += data
        self._fill(len(self.data))
        return self

    def replace(self, start: int, end: int, data: bytes) -> Prefixes:
        """Replace ``[start, end)``; prefixes behind the edit are kept once in step again.

        The entry of a prefix depends on the bytes and entries of the ``longest`` prefixes
        before it, so that this many equal entries in a row make all later ones equal.
        """
        old, shift, same = self.last, len(data) - (end - start), 0
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        for to in range(start + 1, len(self.data) + 1):
            self._fill(to)
            before = to - 1 - shift
            same = same + 1 if to > start + len(data) and old[before] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last.extend(old[before + 1 :])
                break
        return self

    def ids(self) -> list[int]:
        out, at, tokens = [], len(self.data), self.vocabulary.tokens
        while at:
            rank = self.last[at - 1]
            out.append(rank)
            at -= len(tokens[rank])
        return out[::-1]


class Codec:
    """Encode texts piece by piece and decode ids."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in file if line.strip())}
        self.vocabulary = Vocabulary(ranks, memory)
        self.split = regex.compile(pattern).findall
        self.pieces = Recent(self.piece, memory)
        self.known = Recent(lambda x: self.stretch(" " + x), memory)

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        # A piece that is a token stands for itself, also where no merges lead to it.
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, data).ids())

    def stretch(self, text: str) -> tuple[int, ...]:
        pieces = self.split(text)
        if len(pieces) == 1:
            return self.piece(pieces[0])  # remembered as a stretch
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        A single space between other characters always starts a piece, as no piece holds a
        space behind its first character other than in a run of white space.  So the
        stretches between such spaces are encoded, and remembered, apart.
        """
        first, *rest = text.split(" ")
        different = set(rest)
        if first[-1:].isspace() or not all(x and not x[0].isspace() and not x[-1].isspace() for x in different):
            return list(self.stretch(text))
        return [*self.stretch(first), *chain.from_iterable(map(self.known.__getitem__, rest))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, memory: int = MEMORY) -> Codec:
    return Codec(path, pattern, memory)


def _columns(frame: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    from pyspark.sql import functions as F

    return frame.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))


def encode(frame: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` of each row.  The vocabulary is a file every worker has."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema], "ids array<int>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            ids = pa.array([tool.encode(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, "ids"])

    return _columns(frame, text, keep).mapInArrow(work, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``decoded`` bytes of each row's ids; null ids give null."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema], "decoded binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, r".")
        for batch in batches:
            column = [None if row is None else tool.decode(row) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(column, pa.binary())], [*keep, "decoded"]
            )

    return frame.select(*keep, ids).mapInArrow(work, schema)


def digests(
    frame: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", memory: int = MEMORY
) -> DataFrame:
    """Encode and decode every text in one pass; key, number of ids, digests of ids and bytes."""
    schema = f"`{key}` {frame.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern, memory)
        for batch in batches:
            rows = []
            for value in batch.column("_text"):
                ids = tool.encode(value.as_py())
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(tool.decode(ids)).hexdigest(),
                    )
                )
            counts, first, second = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _columns(frame, text, (key,)).mapInArrow(work, schema)
