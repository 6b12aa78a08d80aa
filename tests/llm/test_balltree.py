import math
import random
import re

import numpy as np
import pytest
from llm_data import awkward, empty, sentence, table

from gleaner.llm import balltree
from gleaner.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    rows = [(key, terms(text)) for key, text in docs]
    rows = [(key, t) for key, t in rows if t]
    total, df = sum(len(t) for _, t in rows), {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        wanted = set(terms(text))
        found = []
        for key, t in rows:
            m, score = 50 + 50 * len(t) * len(rows) // total, 0
            for x in wanted & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, key is not None, key or 0))
        out += [(item, n, key if there else None, -score) for n, (score, there, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize(("k", "leaf", "block"), [(50, 16, 8192), (3, 2, 7)])
def test_awkward_rows(spark, k, leaf, block):
    frame = awkward(spark)
    chance = random.Random(5)
    asked = [(1, "w1 W2 w3, w4"), (1, "w1 W2 w3, w4"), (2, None), (3, ""), (4, "..."), (1, "w7"), (None, "ab wörd é"), (5, sentence(chance, 60)), (6, "unknown")]
    got = balltree.search(frame, items(spark, asked), settings=balltree.Settings(k=k, leaf=leaf, block=block))
    want = brute([(r["doc_id"], r["text"]) for r in frame.collect()], asked, k)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_empty_tables_and_item_blocks(spark):
    frame, asked = awkward(spark), [(i, f"w{i} w{i + 1}") for i in range(9)]
    assert balltree.search(empty(spark), items(spark, asked)).collect() == []
    assert balltree.search(frame, items(spark, [])).collect() == []
    got = balltree.search(frame, items(spark, asked), settings=balltree.Settings(block_bytes=20))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute([(r["doc_id"], r["text"]) for r in frame.collect()], asked)


def test_bounds_hold_and_prune():
    """No score of a node is above its bound, and far clusters aren't scored."""
    chance = np.random.default_rng(2)
    rows = [np.sort(c * 10 + chance.permutation(10)[:9]) for c in chance.integers(0, 40, 2000)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term = np.concatenate(rows)
    weight = np.sqrt(chance.integers(1, 9000, 400).astype(float))
    value = (weight[term] ** 2).astype(np.int64) * chance.integers(250_000, 300_000, len(term))
    tree = balltree.Tree(first, term, value, weight, 8)
    query = np.arange(100, 110)
    bound = tree.bounds(query, weight)
    scores = np.array([tree.value[a:b][np.isin(tree.term[a:b], query)].sum() for a, b in zip(tree.first, tree.first[1:], strict=False)])
    for node, (low, high) in enumerate(tree.span):
        assert scores[low:high].max() <= bound[node]
    best = balltree.Best(5)
    best.keys = lambda r: (True, int(r))
    assert tree.search(query, weight, best) < 1000
    assert [-r[0] for r in best.rows] == sorted(scores, reverse=True)[:5]


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    asked = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op11_lexical_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(str(tuple(r)) for r in got) == brute([(r["doc_id"], r["text"]) for r in rows], asked)
