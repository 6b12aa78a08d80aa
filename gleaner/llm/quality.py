"""Quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words (letters, digits) and runs of other marks, in their case.  Features are the
n-grams of one to three tokens, hashed into buckets; an n-gram that repeats one token is
hashed by its length alone, and each word also counts by its form (case, length), as most
words of a junk text are seen once.  A text's vector has the count of
every feature over the square root of their total.  Weights are learned text by text by FTRL-proximal steps, with which rare
features keep the weight zero; a score is a sparse dot product with a broadcast table of
``buckets`` floats.

Defined cases: null and empty texts have no feature and get the score of the bias alone; all
of a long text is scored; without labelled rows every score is 0.5; equal rows score equally;
an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.linear import labelled_sample
from gleaner.llm.scan import SPACES, complete, mix, passes, runs, windows

_CLASSES = np.full(256, 2, np.uint8)
_CLASSES[list(SPACES)] = 0
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


@dataclass(frozen=True)
class Settings:
    rows: int = 4000  # labelled texts of each label that are learned from, at most
    longest: int = 3
    buckets: int = 1 << 18  # a power of two
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    bias: float = 0.3


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    bias: float
    settings: Settings


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every n-gram."""
    tokens = runs(data, offsets, classes=_CLASSES)
    owner = tokens.owner()
    length = tokens.end - tokens.start
    capitals = np.add.reduceat(_UPPER[data], tokens.start) if len(tokens.start) else length
    form = np.minimum(length, 20) * 4 + np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2))
    hashed, texts = [tokens.hash], [owner]
    for size in range(1, s.longest + 1):
        for values, salt in ((tokens.hash, 0), (mix(form.astype(np.uint64) * np.uint64(3) + tokens.kind), 1)):
            if size == 1 and not salt:
                continue
            places, _ = complete(tokens.first, size)
            grams = windows(values, size)[places]
            if size > 1 and not salt:
                same = np.ones(len(places), bool)
                for k in range(1, size):
                    same &= values[places + k] == values[places]
                grams = np.where(same, np.uint64(size), grams)
            hashed.append(mix(grams + np.uint64(salt)))
            texts.append(owner[places])
    return np.concatenate(texts), (np.concatenate(hashed) & np.uint64(s.buckets - 1)).astype(np.int64)


def train(sample: list[tuple[str, int]], s: Settings) -> Model:
    z, n = np.zeros(s.buckets + 1), np.zeros(s.buckets + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    vectors = []
    for text, label in sample:
        data = np.frombuffer(text.encode(), np.uint8)
        _, bucket = features(data, np.array([0, len(data)]), s)
        at, count = np.unique(bucket, return_counts=True)
        # the last weight is the bias
        vectors.append((np.append(at, s.buckets), np.append(count / np.sqrt(max(len(bucket), 1)), s.bias), label))
    for _ in range(s.epochs):
        for at, x, label in vectors:
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / s.alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    w = weights(np.arange(s.buckets + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1] * s.bias), s)


def fit(frame: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    settings = settings or Settings()
    return train(labelled_sample(frame, labels, label, key, text, settings.rows), settings)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    text, bucket = features(data, offsets, model.settings)
    count = np.maximum(np.bincount(text, minlength=texts), 1)
    logit = np.bincount(text, model.table[bucket], texts) / np.sqrt(count) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def predict(frame: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1, of each row."""
    shared = frame.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema], "score double"])
    places = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(shared.value, data, offsets) for _, data, offsets in passes(batch.column(places))]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:places], column], [*keep, "score"])

    return frame.select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(work, schema)
