import random

import numpy as np
import pytest
from llm_data import awkward, empty, sentence, table

from gleaner.llm import quality, toxicity
from gleaner.llm.queries import QUERIES

SMALL = {
    toxicity: toxicity.Settings(rows=40, buckets=1 << 12, epochs=4),
    quality: quality.Settings(rows=40, buckets=1 << 12),
}
LABEL = {toxicity: "toxic", quality: "quality"}


def labels(spark, pairs):
    return spark.createDataFrame([(k, v, v, "clash") for k, v in pairs], "doc_id long, toxic int, quality int, text string")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows(spark, module):
    frame = awkward(spark)
    marks = labels(spark, [*((i, i % 2) for i in range(30)), (None, 1), (5, None), (6, 1), (6, 1), (99999, 1)])
    model = module.fit(frame, marks, settings=SMALL[module])
    rows = module.predict(frame, model, keep=("doc_id", "node")).collect()
    assert len(rows) == frame.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 14]
    assert len(same) == 3 and len(set(same)) == 1
    assert module.predict(empty(spark), model).collect() == []


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("pairs", [[], [(20, 1), (21, 1)], [(20, 0)]])
def test_labels_of_one_kind_or_none(spark, module, pairs):
    frame = awkward(spark)
    model = module.fit(frame, labels(spark, pairs), settings=SMALL[module])
    assert all(0 <= r["score"] <= 1 for r in module.predict(frame, model).collect())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_place_in_a_batch_changes_nothing(module):
    chance = random.Random(1)
    data = [sentence(chance, n) for n in (1, 3, 40, 900)] + ["", "...", "é É"]
    model = module.train([(t, i % 2) for i, t in enumerate(data)], SMALL[module])
    whole = module.scores(model, *toxicity._packed(data))
    alone = np.concatenate([module.scores(model, *toxicity._packed([t])) for t in data])
    assert np.allclose(whole, alone)


def test_misspelt_insults_in_long_texts(spark):
    chance = random.Random(6)
    clean = [sentence(chance, 80) for _ in range(160)]
    bad = [t.replace("w7", "worthlessly", 1) + " idiotic clowns" for t in clean[:80]]
    frame = table(spark, [*clean[80:], *bad])
    model = toxicity.fit(frame, labels(spark, [(i, int(i >= 80)) for i in range(160)]))
    tests = [sentence(chance, 3000) + " idiotics klowns", sentence(chance, 3000), sentence(chance, 12)]
    scores = [r["score"] for r in toxicity.predict(table(spark, tests), model).orderBy("doc_id").collect()]
    assert scores[0] > 0.3 > max(scores[1:])


@pytest.mark.parametrize(("name", "label", "folds", "fold"), [("op6_toxicity", "toxic", 4, 2), ("op10_quality", "quality", 5, 0)])
def test_queries_on_held_out_documents(spark, name, label, folds, fold):
    import zlib

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) > 0.9 * len(held)
