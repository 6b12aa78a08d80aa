"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts.  A text's blocks
are compressed with every dictionary; the language with the fewest bytes wins, and a margin
to the next one below ``margin`` bytes per byte of text, or below ``least`` bytes, is a
rejection.  Both are taken from held-out margins (README): of gibberish and of texts in a
language not learned, one dictionary saves hardly more than the next.

Texts are compared as lower-case letters only: digits, marks and repeated spaces say nothing
about a language.  A fixed filler stands before each block and at the end of each
dictionary, so that also very short texts are coded as matches instead of stored.

Defined cases: null text, empty text and text without a letter give ``und``, score 0 and are
rejected; long texts are cut into blocks whose sizes add up, so all of the text counts; equal
sizes go to the language with more training documents, then to the first by name, and have
margin 0; with no training rows every text is ``und``; repeated rows give equal results; an
empty table gives an empty table; other columns, whatever their names, are neither read nor
returned unless named in ``keep``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scan import bounded_sample

FILLER = b"0123456789" * 6 + b" "
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``documents`` and ``characters`` bound what is learned from; they cut no text scored."""

    documents: int = 400  # sample texts of a language
    characters: int = 4096  # of each sample text, from a hashed place
    dictionary: int = 131_072  # bytes
    level: int = 5
    block: int = 4096
    margin: float = 0.015
    least: int = 3  # bytes


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[tuple[str, bytes], ...]  # most training documents first
    settings: Settings


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def _shared_out(texts: list[bytes], size: int) -> bytes:
    """``size`` bytes of the texts, the same of each; what short ones leave goes to the others."""
    left, share, pieces = size, 0, []
    for n, length in enumerate(sorted(map(len, texts))):
        share = max(left // (len(texts) - n) - 1, 0)  # and a space
        left -= min(length, share) + 1
    for text in texts:
        at = zlib.crc32(text) % (max(len(text) - share, 0) + 1)
        pieces.append(text[at : at + share])
    return b" ".join(pieces)[:size]


def fit(frame: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Model:
    """Learn from a bounded sample of the rows whose text, language and key aren't null."""
    settings = settings or Settings()
    rows = frame.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).na.drop()
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(rows, "_lang", "_key", settings.documents)
    found = (
        rows.join(F.broadcast(chosen), ["_key", "_lang"])
        .groupBy("_lang", "_key")
        .agg(F.min(F.substr("_text", _place(settings), F.lit(settings.characters))).alias("_text"))
        .collect()
    )
    dictionaries = []
    for name in sorted(counts, key=lambda n: (-counts[n], n)):
        texts = sorted((r["_key"], r["_text"]) for r in found if r["_lang"] == name)
        data = _shared_out([folded(t) for _, t in texts], settings.dictionary)
        dictionaries.append((name, data + b" " + FILLER))
    return Model(tuple(dictionaries), settings)


def _place(settings: Settings):
    """Hashed first character of the part of a text that is learned from."""
    later = F.greatest(F.length("_text") - settings.characters, F.lit(0)) + 1
    return (F.pmod(F.xxhash64("_key", "_text"), later) + 1).cast("int")


class Scorer:
    def __init__(self, model: Model):
        s = model.settings
        self.settings, self.languages = s, []
        for name, data in model.dictionaries:
            parameters = zstandard.ZstdCompressionParameters.from_level(
                s.level, source_size=s.block, dict_size=s.dictionary,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.languages.append((name, zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary).compress))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is rejected."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        data, step = folded(text) or b" ", self.settings.block
        blocks = [FILLER + data[i : i + step] + b" " for i in range(0, len(data), step)]
        sizes = [(sum(len(pack(b)) for b in blocks), place) for place, (_, pack) in enumerate(self.languages)]
        ranked = sorted(sizes)
        best = ranked[0][0]
        ahead = ranked[1][0] - best if len(ranked) > 1 else max(len(data), self.settings.least)
        margin = ahead / len(data) if len(ranked) > 1 else 1.0
        score = 1.0 / sum(math.exp(max(best - size, -600) / 2) for size, _ in sizes)
        return self.languages[ranked[0][1]][0], score, margin, margin < self.settings.margin or ahead < self.settings.least


def predict(frame: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` of each row."""
    added = ["lang_pred", "score", "margin", "rejected"]
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema]
    schema = ", ".join([*head, "lang_pred string, score double, margin double, rejected boolean"])
    places = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            rows = [score(t.as_py()) for t in batch.column(places)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:places], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*keep, *added]
            )

    return frame.select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(work, schema)
