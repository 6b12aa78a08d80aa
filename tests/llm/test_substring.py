import hashlib
from collections import Counter

import pytest
from llm_data import awkward, empty, table
from pyspark.sql import functions as F

from gleaner.llm import substring


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return Counter(out)


def found(frame, settings):
    return Counter(tuple(r) for r in substring.remove_repeats(frame, settings=settings).collect())


@pytest.mark.parametrize("size", [3, 6, 35])
@pytest.mark.parametrize("bits", [1 << 9, 1 << 20])
def test_awkward_rows_and_full_filters(spark, size, bits):
    frame = awkward(spark)
    settings = substring.Settings(size=size, filter_bits=bits)
    assert found(frame, settings) == brute([(r["doc_id"], r["text"]) for r in frame.collect()], size)


def test_empty_table(spark):
    assert substring.remove_repeats(empty(spark)).collect() == []


def test_repeats_inside_one_text_overlap(spark):
    rows = [(0, "a b c a b c a b d"), (1, "b c a"), (2, None)]
    assert found(table(spark, [t for _, t in rows]), substring.Settings(size=3, filter_bits=1 << 12)) == brute(rows, 3)


def test_starts_of_equal_rows_do_not_add_up(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)] * 300, "_id long, _text string").repartition(8)
    settings = substring.Settings(size=3, filter_bits=1 << 12)
    rows = substring._starts(docs, settings).collect()
    assert [(r["_id"], sorted(r["_starts"])) for r in rows] == [(1, list(range(18)))]
    same = [(None, text)] * 30
    assert found(table(spark, [text] * 30, [None] * 30), settings) == brute(same, 3)


def test_query_matches_brute_force(spark):
    from gleaner.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(rows, 35)}
    assert {tuple(r) for r in QUERIES["op7_substring_dedup"](spark, folder).collect()} == want


def test_may_hold_never_denies_a_value(spark):
    from gleaner.llm.scan import may_hold

    values = spark.range(-500, 500).select(F.xxhash64("id").alias("h"))
    test = may_hold(values, bits=1 << 16)
    found = spark.range(-5000, 5000).select("id", test(F.xxhash64("id")).alias("may")).where("may").collect()
    ids = {r["id"] for r in found}
    assert set(range(-500, 500)) <= ids and len(ids) < 1500
    assert not spark.range(9).where(may_hold(values.limit(0))(F.col("id"))).count()


def test_a_task_holds_small_batches(spark):
    """Where most windows are candidates, a batch takes many times its bytes."""
    from gleaner.llm.scan import PASS_BYTES, SMALL_BATCH_BYTES, prepare

    substring.remove_repeats(table(prepare(spark), ["a b"] * 3))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(SMALL_BATCH_BYTES)
    assert PASS_BYTES <= 1 << 18
