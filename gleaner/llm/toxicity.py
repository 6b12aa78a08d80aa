"""Toxicity by bags of subword embeddings and a linear softmax.

Words are folded to lower case and letters; a word's features are the character n-grams of
the word between borders, hashed into buckets.  A bag's vector is the mean of its buckets'
embeddings; a linear softmax over it and the embeddings are trained jointly by gradient
steps (AdaGrad).  Misspellings share n-grams, so vectors, with the words learned.

A text is cut into bags of a few words, as a few words among thousands make it toxic and
would vanish in one mean.  Labels are of texts, not bags: a toxic text's probability is that
of its most toxic bags, so these learn the label, while all bags of a clean text learn to be
clean.  Scores combine the bags in the same way.

Only the difference of the two softmax logits matters, so a bag's score is the mean of one
number a bucket: a broadcast table of ``buckets`` floats, whatever the size of the corpus.

Defined cases: null, empty and letterless texts have no bag and score ``empty``; all of a long
text is scored; with labels of one kind only, every text gets the probability of that label
smoothed by one; equal rows score equally; an empty table gives an empty table; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.linear import labelled_sample
from gleaner.llm.scan import mix, passes, powers

# Letters are ASCII letters, digits and every byte of a longer UTF-8 sequence; 0 separates.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = 48  # all digits are one letter
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Settings:
    rows: int = 1500  # labelled texts of each label that are learned from, at most
    shortest: int = 3  # n-grams of bytes, word borders included
    longest: int = 6
    buckets: int = 1 << 17
    size: int = 12  # of an embedding
    bag: int = 8  # words
    least: int = 40  # n-grams that a mean is taken over at least, so that a lone word says less
    epochs: int = 6
    rate: float = 0.3
    empty: float = 0.0


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # one number a bucket: the effect on the logit of a bag
    bias: float
    prior: float | None  # the only answer, where there was nothing to tell apart
    settings: Settings


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, their bag, and the text of each bag; bags are in text order."""
    texts = len(offsets) - 1
    # A border before each text keeps words of neighbours apart.
    folded = np.zeros(len(data) + texts + 1, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))
    folded[place] = _FOLD[data]
    letter = folded > 0
    start = np.zeros(len(folded), bool)
    start[1:] = letter[1:] & ~letter[:-1]
    word = np.cumsum(start) - 1
    heads = np.flatnonzero(start)
    owner = np.searchsorted(offsets + np.arange(texts + 1), heads, side="right") - 1
    first = np.searchsorted(owner, np.arange(texts))
    rank = np.arange(len(heads)) - first[owner] if len(heads) else heads
    begins = rank % s.bag == 0
    bag_of_word = np.cumsum(begins) - 1
    values = mix(folded.astype(np.uint64) + np.uint64(1))
    buckets, bags = [], []
    for n in range(s.shortest, s.longest + 1):
        count = len(folded) - n + 1
        if count <= 0:
            continue
        # All but the first and last byte are letters, so at most one border on either side.
        whole = np.cumsum(np.concatenate([[0], ~letter]))
        ok = np.flatnonzero(whole[n - 1 : n - 1 + count] == whole[1 : 1 + count])
        hashed = np.zeros(len(ok), np.uint64)
        for k, p in enumerate(powers(n)):
            hashed += values[ok + k] * p
        buckets.append((mix(hashed + np.uint64(n)) % np.uint64(s.buckets)).astype(np.int32))
        bags.append(bag_of_word[word[ok + 1]])
    if not buckets or not len(heads):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(bags), owner[begins]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def train(sample: list[tuple[str, int]], s: Settings) -> Model:
    """Embeddings and softmax weights, jointly, from (text, label)."""
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), 0.0, (labels.sum() + 1) / (len(labels) + 2), s)
    random = np.random.default_rng(5)
    table = random.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32)
    weights, bias = random.normal(0, 0.1, s.size).astype(np.float32), np.float32(-1)
    table_sum, weight_sum, bias_sum = np.full(s.buckets, 1e-6, np.float32), np.float32(1e-6), np.float32(1e-6)
    step = 64
    for epoch in range(s.epochs):
        order = random.permutation(len(sample))
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            bucket, bag, text = features(*_packed([sample[i][0] for i in rows]), s)
            if not len(text):
                continue
            count = np.maximum(np.bincount(bag, minlength=len(text)), s.least).astype(np.float32)
            used, place = np.unique(bucket, return_inverse=True)
            # Means of embeddings, as a sparse product summed by bag.
            mean = np.empty((len(text), s.size), np.float32)
            for d in range(s.size):
                mean[:, d] = np.bincount(bag, table[bucket, d], len(text))
            mean /= count[:, None]
            logit = mean @ weights + bias
            chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            y = labels[rows][text]
            # Of a toxic text only the bags near its most toxic one learn that they are.
            top = np.full(len(rows), -np.inf, np.float32)
            np.maximum.at(top, text, logit)
            share = np.where(y == 1, logit >= top[text] - (4.0 if epoch == 0 else 0.5), True)
            size = np.bincount(text, share, len(rows))[text]
            error = np.where(share, chance - y, 0) * np.where(y == 1, 1.0, 4.0) / np.sqrt(size)
            gradient = (error / count).astype(np.float32)
            push = np.bincount(place, gradient[bag], len(used)).astype(np.float32)
            old = weights.copy()
            grad = error.astype(np.float32) @ mean
            weight_sum += float((grad**2).mean())
            weights -= s.rate * grad / np.sqrt(weight_sum)
            bias_sum += float(error.sum() ** 2)
            bias -= np.float32(s.rate * error.sum() / np.sqrt(bias_sum))
            delta = push[:, None] * old[None, :]
            table_sum[used] += (delta**2).mean(axis=1)
            table[used] -= s.rate * delta / np.sqrt(table_sum[used])[:, None]
    return Model((table @ weights).astype(np.float32), float(bias), None, s)


def fit(frame: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    settings = settings or Settings()
    return train(labelled_sample(frame, labels, label, key, text, settings.rows), settings)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each text: that of its most toxic bag."""
    texts = len(offsets) - 1
    if model.prior is not None:
        return np.full(texts, model.prior)
    bucket, bag, text = features(data, offsets, model.settings)
    top = np.full(texts, -np.inf)
    if len(text):
        count = np.maximum(np.bincount(bag, minlength=len(text)), model.settings.least)
        logit = np.bincount(bag, model.table[bucket], len(text)) / count + model.bias
        np.maximum.at(top, text, logit)
    chance = 1 / (1 + np.exp(-np.clip(top, -40, 40)))
    return np.where(np.isinf(top), model.settings.empty, chance)


def predict(frame: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of each row."""
    shared = frame.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema], "score double"])
    places = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(shared.value, data, offsets) for _, data, offsets in passes(batch.column(places))]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:places], column], [*keep, "score"])

    return frame.select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(work, schema)
