import numpy as np
import public_tokenizers
import pytest
from llm_data import awkward, empty

from gleaner.llm import training_order
from gleaner.llm.training_order import Permutation, Settings, sequences, shards, token_table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 4097, 100_000])
def test_permutation_is_a_keyed_bijection(count):
    order = Permutation(count, Settings())
    slots = order.slots(np.arange(count))
    assert sorted(slots.tolist()) == list(range(count))
    assert (order.numbers(slots) == np.arange(count)).all()
    if count > 1000:
        assert (slots != Permutation(count, Settings(key=1)).slots(np.arange(count))).mean() > 0.9


def test_round_trip_of_awkward_rows(spark, tmp_path):
    s = Settings(length=16, shard=8)
    frame = awkward(spark)
    shards(token_table(frame, PATH, PATTERN, "doc_id", "text", s), s).write.parquet(str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    for r in written.collect():
        assert r["first_slot"] == 8 * r["shard"] and len(r["payload"]) == r["n_sequences"] * s.stride
    rows = sequences(written, settings=s).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    tool = training_order.tokenizer(PATH, PATTERN)
    want = sorted((str(r["doc_id"]), [*tool.encode_ordinary(r["text"] or ""), tool.n_vocab]) for r in frame.collect())
    parts = sorted((str(r["doc_id"]), r["part"], r["ids"]) for r in rows)
    cut = sorted((k, i // 16, ids[i : i + 16]) for k, ids in want for i in range(0, len(ids), 16))
    assert parts == cut


def test_reader_goes_on_at_any_slot(spark):
    s = Settings(length=16, shard=8)
    found = shards(token_table(awkward(spark), PATH, PATTERN, "doc_id", "text", s), s).persist()
    rows = {r["slot"]: r["ids"] for r in sequences(found, settings=s).collect()}
    later = {r["slot"]: r["ids"] for r in sequences(found, 21, s).collect()}
    assert later == {k: v for k, v in rows.items() if k >= 21}
    found.unpersist()


def test_empty_table(spark):
    assert shards(token_table(empty(spark), PATH, PATTERN, "doc_id", "text", Settings())).collect() == []


def test_messages_of_any_size_give_the_same_table(spark, monkeypatch):
    s, frame = Settings(length=16, shard=8), awkward(spark).coalesce(1)
    whole = token_table(frame, PATH, PATTERN, "doc_id", "text", s).orderBy("task", "place").collect()
    monkeypatch.setattr(training_order, "ROWS", 3)
    cut = token_table(frame, PATH, PATTERN, "doc_id", "text", s).orderBy("task", "place").collect()
    assert whole == cut and [r["place"] for r in whole] == list(range(len(whole)))
