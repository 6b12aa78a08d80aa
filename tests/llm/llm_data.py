"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _key string, score int, node string"
AWKWARD = [None, "", " \t\n", "a", "one two", "...", "Ab aB ab AB", "x" * 5000, "é" * 300, "wörd " * 9, "\x0b\x0c a b  c"]


def sentence(chance, words, vocabulary=400):
    return " ".join(f"w{chance.randrange(vocabulary)}" for _ in range(words))


def texts(seed=1):
    """Prose, exact and near copies, a passage shared by some, repeated lines, a very long text."""
    chance = random.Random(seed)
    base = [sentence(chance, chance.choice([5, 20, 60, 120])) for _ in range(12)]
    passage = sentence(chance, 40)
    near = [t.replace("w1 ", "v1 ", 1) for t in base]
    shared = [f"{sentence(chance, 15)} {passage} {sentence(chance, 9)}" for _ in range(4)]
    lines = "\n".join([sentence(chance, 6)] * 5 + [sentence(chance, 8)])
    return [*base, *base[:5], *near, *shared, lines, sentence(chance, 30_000, 5000)]


def table(spark, values=None, ids=None):
    """Documents with clashing extra columns, null ids and a repeated row."""
    values = [*AWKWARD, *texts()] if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    rows = [(i, t, ("en", "de", None)[k % 3], None if k % 5 == 4 else f"s{k % 2}", 1, "other", "k", 7, "n") for k, (i, t) in enumerate(zip(ids, values))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    values = [*AWKWARD, *texts()]
    values += [values[14], values[14]]
    ids = [*range(len(values) - 2), 14, 14]
    ids[3] = ids[15] = None
    return table(spark, values, ids)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
