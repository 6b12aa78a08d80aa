import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import views
from gleaner.sources import timeline
from gleaner.sources.store import DatasetStore


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    chance = random.Random(4)
    rows = [(None if chance.random() < 0.15 else f"2024-01-{chance.randrange(1, 29):02d} 00:00:0{chance.randrange(3)}", f"k{i:04d}", i) for i in range(600)]
    view = spark.createDataFrame(rows, "time string, stable_id string, n int").withColumn("time", F.col("time").cast("timestamp_ntz"))
    view = view.cache()
    return view, timeline.build(view, str(tmp_path_factory.mktemp("t") / "line"), 12)


def walk(read):
    out, after = [], None
    while True:
        page = read(after)
        out += [(r["time"], r["stable_id"], r["n"]) for r in page.rows]
        if not page.has_more:
            return out, page.total
        after = page.next_key


@pytest.mark.parametrize(("direction", "lower", "upper"), [("desc", None, None), ("asc", "2024-01-05", "2024-01-20T00:00:01"), ("asc", None, None)])
def test_walk_is_the_view_in_order(spark, made, direction, lower, upper):
    view, line = made
    got, total = walk(lambda after: line.page(97, after, direction, lower, upper))
    wanted = views.keyset_rows(views.time_range(view, lower, upper), 1000, None, direction).collect()
    assert got == [(r["time"], r["stable_id"], r["n"]) for r in wanted] and total == len(wanted)


def test_a_page_reads_the_files_of_its_range_only(spark, made):
    _, line = made
    every = line.files().count()
    first = line.page(20)
    assert every >= 10 and len(line.page_files(20)) <= 2
    rows = line.page_rows(20, first.next_key)
    assert len(rows.inputFiles()) <= 3 and first.total == 600 == first.next_key.total
    assert len(line.page_rows(20, None, "desc", "2024-01-10", "2024-01-11").inputFiles()) <= 2


def test_keys_of_other_filters_are_refused(spark, made):
    _, line = made
    key = line.page(5).next_key
    for other in ({"direction": "asc"}, {"lower": "2024-01-01"}):
        with pytest.raises(ValueError, match="other filters"):
            line.page(5, key, **other)
    with pytest.raises(ValueError, match="page size"):
        line.page(0)
    with pytest.raises(ValueError, match="after its start"):
        line.page(5, lower="2024-01-02", upper="2024-01-01")


def test_empty_view_and_store(spark, made, tmp_path):
    view, _ = made
    empty = timeline.build(view.where("false"), str(tmp_path / "empty"))
    page = empty.page(5)
    assert (page.rows, page.total, page.has_more) == ([], 0, False)
    store = DatasetStore(spark, str(tmp_path / "ds"), buckets=2)
    batch = lambda n: spark.range(n).select(F.col("id").cast("string").alias("natural_key"), F.lit("{}").alias("data"), F.lit("h").alias("data_hash"))
    assert store.timeline().page(5).total == 0
    store.commit(batch(7), "r1", "2024-01-01T00:00:00", {})
    line = store.timeline()
    first = line.page(5)
    store.commit(batch(9), "r2", "2024-01-02T00:00:00", {})
    assert (first.total, len(line.page(5, first.next_key).rows)) == (7, 2)  # the walk goes on as it began
    assert store.timeline().page(5).total == 9 and store.timeline().path == store.timeline().path
