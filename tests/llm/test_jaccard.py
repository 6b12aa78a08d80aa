import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_data import awkward, empty, sentence, table
from pyspark.sql import functions as F

from gleaner.llm import jaccard
from gleaner.llm.graph import components


def shingles(text):
    words = bytes((text or "").encode()).lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(size, least id reachable) by row number."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * same >= 80 * union:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)

    def name(i):
        if not sets[i]:
            return rows[i][0]
        return min((rows[k][0] for k in groups[find(i)] if rows[k][0] is not None), default=None)

    return Counter((rows[i][0], len(sets[i]), name(i)) for i in range(len(rows)))


def found(frame, **options):
    return Counter(tuple(r) for r in jaccard.join(frame, **options).collect())


def test_awkward_rows(spark):
    frame = awkward(spark)
    assert found(frame) == brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert jaccard.join(empty(spark)).collect() == []


def test_random_sets_near_the_threshold(spark):
    chance, rows = random.Random(5), []
    for _ in range(120):
        size = chance.choice([1, 2, 4, 5, 6, 9, 10, 13, 17, 25, 36, 50, 64, 100, 140, 260])
        words = sentence(chance, size, 5000).split()
        for _ in range(chance.randrange(1, 6)):
            copy = list(words)
            for _ in range(chance.randrange(0, max(1, size // 25) + 2)):
                if chance.random() < 0.6:
                    copy[chance.randrange(len(copy))] = f"w{chance.randrange(5000)}"
                else:
                    copy += sentence(chance, chance.randrange(1, max(2, size // 8)), 5000).split()
            rows.append((len(rows), " ".join(copy)))
    assert found(table(spark, [t for _, t in rows])) == brute(rows)


def test_group_of_near_copies_is_one_component(spark):
    chance = random.Random(2)
    base = sentence(chance, 300, 5000).split()
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(chance.randrange(0, 7)):
            copy[chance.randrange(len(copy))] = f"v{chance.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    assert found(table(spark, [t for _, t in rows])) == brute(rows)


def test_links_inside_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Also where the sets met first link nothing, a set is compared with few of a large group."""
    chance, texts, looked = random.Random(8), [], []
    base = sentence(chance, 300, 5000).split()
    for _ in range(200):
        copy = list(base)
        for _ in range(chance.randrange(0, 7)):
            copy[chance.randrange(len(copy))] = f"v{chance.randrange(9999)}"
        texts.append(" ".join(copy))
    verify = jaccard._verified
    monkeypatch.setattr(jaccard, "_first_links", lambda shared, known, s: known.selectExpr("node AS a", "node AS b").limit(0))
    monkeypatch.setattr(jaccard, "_verified", lambda docs, pairs, *rest: looked.append(pairs.distinct().count()) or verify(docs, pairs, *rest))
    options = {"settings": jaccard.Settings(few=1, enough=1)} if hasattr(jaccard.Settings, "few") else {}
    assert found(table(spark, texts), **options) == brute(list(enumerate(texts)))
    assert 0 < sum(looked) < len(texts) ** 2 // 5, looked


def test_near_copies_under_the_threshold_are_brought_up_once(spark, monkeypatch):
    chance, texts, met = random.Random(4), [], []
    base = sentence(chance, 300, 5000).split()
    for i in range(120):
        copy = list(base)
        for at, width in zip(chance.sample(range(5, 290, 6), 3), (2, 2, 1), strict=True):
            for k in range(width):
                copy[at + k] = f"x{i}y{at + k}"
        texts.append(" ".join(copy))
    meet = jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda *given: met.append(meet(*given)) or met[-1])
    assert found(table(spark, texts)) == brute(list(enumerate(texts)))
    pairs = met[0].selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    once = pairs.distinct().count()
    assert 0 < pairs.count() <= 1.2 * once


def test_sets_without_spare_segments_meet_all_of_like_size(spark, monkeypatch):
    """With far too few segments many sets are short of units; the result stays whole."""
    monkeypatch.setattr(jaccard, "_listed", lambda size, m, s: min(m, s.budget(2 * size) + 1))
    chance = random.Random(9)
    rows = [(i, sentence(chance, 12, 14)) for i in range(40)]
    assert found(table(spark, [t for _, t in rows]), settings=jaccard.Settings(words=1)) == brute_words(rows)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_every_segment_of_a_probe_is_indexed_by_smaller_partners(percent):
    s = jaccard.Settings(percent=percent)
    for band in range(11):
        m, first = jaccard.segments(band, s)
        top = ((2 << band) - 1) * 100 // percent
        probe = {y: jaccard._listed(y, m, s) for y in range(1 << band, top + 1)}
        assert first <= min(probe.values())
        for x in range(1 << band, 2 << band):
            assert jaccard._indexed(x, m, s) >= max(probe[y] for y in range(x, x * 100 // percent + 1))


@pytest.mark.parametrize("small, large, different", [(35, 36, 7), (35, 37, 8), (40, 41, 9)])
def test_pairs_between_the_steps_of_the_budget_are_linked(spark, small, large, different):
    """Pairs of at least 80 %, each of words of its own."""
    texts, same = [], (small + large - different) // 2
    for i in range(600):
        words = [f"w{i}x{k}" for k in range(small + large - same)]
        texts += [" ".join(words[:small]), " ".join(words[:same] + words[small:])]
    rows = jaccard.join(table(spark, texts), settings=jaccard.Settings(words=1)).collect()
    assert [r["doc_id"] for r in rows if r["component_id"] != r["doc_id"] // 2 * 2] == []


def brute_words(rows):
    sets = [frozenset(t.lower().split()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for i in range(len(rows)):
        least[find(i)] = min(least[find(i)], i)
    return Counter((i, len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 4), (200, 201)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 130)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_units_are_sorted_once_and_narrow(spark):
    s = jaccard.Settings()
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "id long, _text string")
    plan = jaccard._shared(jaccard._rows(docs, s), s)._jdf.queryExecution().sparkPlan().toString()
    executed = jaccard._shared(jaccard._rows(docs, s), s)._jdf.queryExecution().executedPlan().toString()
    assert "packed" in plan and executed.count("Sort [") == 1 and executed.count("Exchange hashpartitioning(sig") == 1


def test_packed_columns_keep_their_values(spark):
    size, slack, role = np.array([1, 2**30 - 1, 7]), np.array([-(2**28), 2**30 - 1, 0]), np.array([0, 7, 3])
    values = jaccard.packed(size, slack, role).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "p long").select(*jaccard.unpacked("p"))
    assert [tuple(r) for r in frame.collect()] == list(zip(size.tolist(), slack.tolist(), role.tolist(), strict=True))


def test_texts_are_fetched_without_building_all_sets(spark, monkeypatch):
    """Candidates' texts are told by a stored hash of the text; equal texts bring one row."""
    s = jaccard.Settings()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f"] * 40 + ["A b c d e f", "other", ""])], "_key long, _text string").repartition(5)
    nodes = jaccard._nodes(docs, s)
    known = nodes.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "digest")])
    asked = nodes.where("_key = 40").select("node")
    monkeypatch.setattr(jaccard, "Sets", None)
    rows = jaccard._texts(docs, asked, known, s).collect()
    assert [r["text"].lower() for r in rows] == ["a b c d e f"]


def test_sets_hold_each_token_of_a_text_once():
    texts = ["a b c d e a b c d e a b c d e", "a b c d e", "a b", "a b", "", "x y z x y z x y z", "a b c d e f"]
    data = "".join(texts).encode()
    sets = jaccard.Sets(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t) for t in texts]), jaccard.Settings())
    assert sets.size.tolist() == [5, 1, 1, 1, 0, 3, 2]
    assert all(len(set(sets.token[a:b].tolist())) == b - a for a, b in zip(sets.first, sets.first[1:], strict=False))
