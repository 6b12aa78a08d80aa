"""Store scenarios: repeated runs, blocked runs, review, pages, streaming batches."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.records import content_hash
from gleaner.operators import review, views
from gleaner.sources.store import DatasetStore
from gleaner.streaming import jobs


def batch(spark, *rows):
    df = spark.createDataFrame(rows, "natural_key string, value string")
    return df.withColumns({"data": F.to_json(F.struct("natural_key", "value")), "data_hash": content_hash(["natural_key", "value"])}).drop("value")


@pytest.fixture()
def store(spark, tmp_path):
    return DatasetStore(spark, str(tmp_path / "ds"), buckets=4)


def test_two_identical_runs(spark, store):
    first = store.commit(batch(spark, ("a", "1"), ("b", "1")), "r1", "2024-01-01T00:00:00")
    second = store.commit(batch(spark, ("a", "1"), ("b", "1")), "r2", "2024-01-02T00:00:00")
    assert (first.counters["created"], second.counters["unchanged"], second.counters["created"]) == (2, 2, 0)
    assert store.versions().count() == 2 and store.observations().count() == 4
    latest = store.latest_run().collect()
    assert {r["run_id"] for r in latest} == {"r2"} and len(latest) == 2
    again = store.commit(batch(spark, ("a", "9")), "r2", "2024-01-03T00:00:00")
    assert again.repeated and store.observations().count() == 4


def test_change_pending_and_number(spark, store):
    store.commit(batch(spark, ("a", "1")), "r1", "2024-01-01T00:00:00")
    policy = {"changed": True}
    for i, value in enumerate(("2", "2", "1", "3")):
        store.commit(batch(spark, ("a", value)), f"p{i}", f"2024-01-0{i + 2}T00:00:00", policy)
    record = store.records().first()
    assert (record["current_version"], record["last_version"], record["review_status"]) == (1, 4, "APPROVED")
    numbers = {r["run_id"]: r["version_number"] for r in store.observations().collect()}
    assert numbers == {"r1": 1, "p0": 2, "p1": 3, "p2": 1, "p3": 4}
    assert store.current().first()["version_run_id"] == "r1"
    store.commit(batch(spark, ("a", "4")), "ok", "2024-01-09T00:00:00")
    assert store.records().first()["current_version"] == 5


def test_blocked_runs_write_nothing(spark, store):
    twice = store.commit(batch(spark, ("a", "1"), ("a", "2")), "r1", "2024-01-01T00:00:00")
    none = store.commit(batch(spark, (None, "1")), "r2", "2024-01-01T00:00:00")
    assert (twice.reason, none.reason) == ("DUPLICATE_NATURAL_KEY", "NATURAL_KEY_MISSING")
    assert store.manifest().isEmpty() and store.records().isEmpty() and store.versions().isEmpty()
    assert {r["run_id"] for r in store.blocked_runs().collect()} == {"r1", "r2"}


def test_empty_run_has_no_fallback(spark, store):
    store.commit(batch(spark, ("a", "1")), "r1", "2024-01-01T00:00:00")
    store.commit(batch(spark, ("a", "1")).where("false"), "r2", "2024-01-02T00:00:00")
    assert store.last_commit()["run_id"] == "r2" and store.last_commit()["observed_count"] == 0
    assert store.latest_run().isEmpty() and store.current().count() == 1


def test_untouched_buckets_keep_their_files(spark, store):
    keys = [(f"k{i}", "1") for i in range(40)]
    store.commit(batch(spark, *keys), "r1", "2024-01-01T00:00:00")
    store.commit(batch(spark, ("k0", "2"), ("new", "1")), "r2", "2024-01-02T00:00:00")
    assert {int(f.split("-")[0]) for f in store.last_commit()["buckets"].values()} == {1, 2}
    assert store.records().count() == 41
    assert store.records().where("natural_key = 'k0'").first()["current_version"] == 2


def test_review_through_the_store(spark, store):
    store.commit(batch(spark, ("a", "1"), ("b", "1")), "r1", "2024-01-01T00:00:00", {"new": True})
    store.commit(batch(spark, ("a", "2"), ("b", "1")), "r2", "2024-01-02T00:00:00", {"changed": True, "sample_unchanged": 1})
    assert {r["task_id"] for r in store.review_tasks().collect()} == {
        "r1|NEW_RECORD|a", "r1|NEW_RECORD|b", "r2|CHANGED_RECORD|a", "r2|SAMPLED_RECORD|b",
    }
    first = decide(spark, ("r2|CHANGED_RECORD|a", "APPROVED", None, None, 1), ("r1|NEW_RECORD|b", "REJECTED", None, None, 2))
    assert store.review(first, "v1", "2024-01-03T00:00:00").isEmpty()
    got = {r["natural_key"]: (r["current_version"], r["review_status"], r["status"]) for r in store.records().collect()}
    assert got == {"a": (2, "APPROVED", "ACTIVE"), "b": (1, "REJECTED", "REJECTED")}
    states = {(r["natural_key"], r["version_number"]): r["review_status"] for r in store.versions().collect()}
    assert states == {("a", 1): "PENDING", ("a", 2): "APPROVED", ("b", 1): "REJECTED"}
    late = store.review(decide(spark, ("r1|NEW_RECORD|b", "APPROVED", None, None, 1)), "v2", "2024-01-04T00:00:00")
    assert [r["status"] for r in late.collect()] == ["REJECTED"]
    assert store.review(first, "v1", "2024-01-05T00:00:00").isEmpty() and store.manifest().count() == 4
    assert [r["natural_key"] for r in store.current().collect()] == ["a"]
    assert store.dataset_runs().count() == 2 and store.last_commit("run")["run_id"] == "r2"
    again = store.commit(batch(spark, ("a", "2")), "r3", "2024-01-06T00:00:00")
    assert again.counters["unchanged"] == 1


def state(spark):
    records = spark.createDataFrame(
        [("a", 1, "d1", "h1", "PENDING", "ACTIVE"), ("b", 1, "d1", "h1", "APPROVED", "ACTIVE"), ("c", 1, "d1", "h1", "APPROVED", "ACTIVE")],
        "natural_key string, current_version long, data string, data_hash string, review_status string, status string",
    )
    versions = spark.createDataFrame(
        [("a", 1, "r1", "d1", "h1", "PENDING"), ("b", 1, "r1", "d1", "h1", "APPROVED"), ("b", 2, "r2", "d2", "h2", "PENDING"), ("c", 1, "r1", "d1", "h1", "APPROVED")],
        "natural_key string, version_number long, run_id string, data string, data_hash string, review_status string",
    )
    tasks = spark.createDataFrame(
        [("t1", "a", "r1", "NEW_RECORD", "d1", "h1", "PENDING"), ("t2", "b", "r2", "CHANGED_RECORD", "d2", "h2", "PENDING"), ("t3", "c", "r3", "SAMPLED_RECORD", "d1", "h1", "PENDING"), ("t4", "c", "r3", "SAMPLED_RECORD", "d1", "h1", "APPROVED")],
        "task_id string, natural_key string, run_id string, reason string, new_data string, new_hash string, status string",
    )
    return records, versions, tasks


def decide(spark, *rows):
    return spark.createDataFrame(rows, "task_id string, decision string, corrected_data string, corrected_hash string, decided_seq long")


def test_review_decisions(spark):
    records, versions, tasks = state(spark)
    out = review.apply_decisions(
        records, versions, tasks,
        decide(spark, ("t1", "REJECTED", None, None, 1), ("t2", "APPROVED", None, None, 2), ("t3", "CORRECTED", "d9", "h9", 3), ("t4", "REJECTED", None, None, 4)),
    )
    got = {r["natural_key"]: (r["current_version"], r["data"], r["review_status"], r["status"]) for r in out.records.collect()}
    assert got == {"a": (1, "d1", "REJECTED", "REJECTED"), "b": (2, "d2", "APPROVED", "ACTIVE"), "c": (2, "d9", "CORRECTED", "ACTIVE")}
    numbers = {(r["natural_key"], r["version_number"]): r["review_status"] for r in out.versions.collect()}
    assert numbers == {("a", 1): "REJECTED", ("b", 1): "APPROVED", ("b", 2): "APPROVED", ("c", 1): "APPROVED", ("c", 2): "CORRECTED"}
    assert [r["task_id"] for r in out.conflicts.collect()] == ["t4"]


def test_rejected_sample_changes_only_the_task(spark):
    records, versions, tasks = state(spark)
    out = review.apply_decisions(records, versions, tasks, decide(spark, ("t3", "REJECTED", None, None, 1)))
    assert out.records.exceptAll(records).isEmpty() and out.versions.exceptAll(versions).isEmpty()
    assert out.tasks.where("task_id = 't3'").first()["status"] == "REJECTED"


def paged(spark):
    rows = [("i1", "2024-01-01 00:00:00"), ("i2", "2024-01-02 00:00:00"), ("i3", None), ("i4", "2024-01-02 00:00:00"), ("i5", None)]
    return spark.createDataFrame(rows, "stable_id string, t string").select("stable_id", F.col("t").cast("timestamp_ntz").alias("time"))


@pytest.mark.parametrize("direction,order", [("desc", ["i4", "i2", "i1", "i5", "i3"]), ("asc", ["i1", "i2", "i4", "i3", "i5"])])
def test_keyset_walk(spark, direction, order):
    df, seen, key = paged(spark), [], None
    while True:
        page = views.read_page(df, 2, key, direction, (("view", "x"),))
        assert page.total == 5
        seen += [r["stable_id"] for r in page.rows]
        if not page.has_more:
            break
        key = page.next_key
    assert seen == order
    with pytest.raises(ValueError):
        views.read_page(df, 2, key, direction, (("view", "other"),))


def test_exact_second(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:56.8")], "id string, t string").select("id", F.col("t").cast("timestamp_ntz").alias("time"))
    assert views.at_second(df, "2024-01-01T00:00:56").count() == 1
    assert views.at_second(df, "2024-01-01T00:00:57").count() == 0
    with pytest.raises(ValueError):
        views.time_range(df, "2024-01-02", "2024-01-01")


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "ds"), buckets=4)
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "natural_key string, value string")
    rows.coalesce(1).write.parquet(source)

    def prepare(df):
        return df.withColumns({"data": F.to_json(F.struct("natural_key", "value")), "data_hash": content_hash(["natural_key", "value"])}).drop("value")

    def run(checkpoint):
        stream = spark.readStream.schema("natural_key string, value string").parquet(source)
        jobs.ingest(stream, store, prepare, lambda n: f"2024-01-0{n + 1}T00:00:00", checkpoint).start().awaitTermination(120)

    first = str(tmp_path / "cp1")
    run(first)
    run(first)
    assert store.manifest().count() == 1 and store.records().count() == 2
    run(str(tmp_path / "cp2"))  # a lost checkpoint replays batch 0
    assert store.manifest().count() == 1 and store.observations().count() == 2
    spark.createDataFrame([("a", "2")], "natural_key string, value string").coalesce(1).write.mode("append").parquet(source)
    run(first)
    assert store.records().where("natural_key = 'a'").first()["current_version"] == 2


def test_streaming_change_feed_and_limits(spark, tmp_path):
    source = str(tmp_path / "feed")
    schema = "k string, h string, ts timestamp"
    stream = spark.readStream.schema(schema).parquet(source + "*")

    def put(*rows):
        df = spark.createDataFrame(rows, "k string, h string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)

    put(("a", "1", "2024-01-01 00:00:00"), ("a", "2", "2024-01-01 00:00:30"), ("b", "1", "2024-01-01 00:00:10"))
    feed = jobs.changed_payloads(stream, "k", "h", "ts").writeStream.format("memory").queryName("feed").outputMode("update").start()
    try:
        feed.processAllAvailable()
        put(("a", "2", "2024-01-01 00:02:00"), ("b", "3", "2024-01-01 00:02:00"))
        feed.processAllAvailable()
        assert sorted(map(tuple, spark.table("feed").collect())) == [("a", "2"), ("b", "1"), ("b", "3")]
    finally:
        feed.stop()
    counts = jobs.requests_per_minute(stream, 1, token="k").writeStream.format("memory").queryName("limits").outputMode("complete").start()
    try:
        counts.processAllAvailable()
        got = {(r["k"], str(r["bucket_start"])): (r["accepted"], r["rejected"]) for r in spark.table("limits").collect()}
        assert got[("a", "2024-01-01 00:00:00")] == (1, 1) and got[("b", "2024-01-01 00:02:00")] == (1, 0)
    finally:
        counts.stop()


def test_streaming_unique_observations(spark, tmp_path):
    source = str(tmp_path / "obs")
    spark.createDataFrame([("r1", "a", "2024-01-01 00:00:00"), ("r1", "a", "2024-01-01 00:00:05"), ("r2", "a", "2024-01-01 00:00:09")], "run_id string, natural_key string, t string").withColumn(
        "observed_at", F.col("t").cast("timestamp")
    ).drop("t").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("run_id string, natural_key string, observed_at timestamp").parquet(source)
    query = jobs.unique_observations(stream).writeStream.format("memory").queryName("unique_obs").start()
    try:
        query.processAllAvailable()
        assert spark.table("unique_obs").count() == 2
    finally:
        query.stop()


def plain_batch(spark, *rows):
    return spark.createDataFrame([(k, f"h{v}", f'{{"v":{v}}}') for k, v in rows], "natural_key string, data_hash string, data string")


def test_dead_run_stays_invisible_and_can_be_retried(spark, tmp_path, monkeypatch):
    store = DatasetStore(spark, str(tmp_path / "store"), buckets=4)
    store.commit(plain_batch(spark, ("a", 1)), "r1", "2024-01-01T00:00:00", {"new": True})
    with monkeypatch.context() as patch:
        patch.setattr(store, "_write_records", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.commit(plain_batch(spark, ("a", 2), ("b", 1)), "r2", "2024-01-02T00:00:00")
    task = store.review_tasks().first()["task_id"]
    decisions = spark.createDataFrame([(task, "APPROVED", None, None, 1)], "task_id string, decision string, corrected_data string, corrected_hash string, decided_seq int")
    store.review(decisions, "v1", "2024-01-03T00:00:00")
    assert {r["run_id"] for r in store.observations().collect()} == {"r1"}
    store.commit(plain_batch(spark, ("a", 2), ("b", 1)), "r2", "2024-01-04T00:00:00")
    ids = [r["observation_id"] for r in store.observations().collect()]
    assert sorted(ids) == ["r1|a", "r2|a", "r2|b"]


def test_unchanged_rerun_rewrites_no_bucket(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "store"), buckets=4)
    store.commit(plain_batch(spark, ("a", 1), ("b", 1)), "r1", "2024-01-01T00:00:00")
    before = store.last_commit()["buckets"]
    store.commit(plain_batch(spark, ("a", 1), ("b", 1)), "r2", "2024-01-02T00:00:00")
    assert store.last_commit()["buckets"] == before and store.last_commit()["unchanged"] == 2


def test_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    one, two = (DatasetStore(spark, str(tmp_path / "store"), buckets=4) for _ in range(2))
    publish = one._publish

    def late(*args):
        two.commit(plain_batch(spark, ("b", 1)), "r2", "2024-01-01T00:00:00")
        publish(*args)

    monkeypatch.setattr(one, "_publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        one.commit(plain_batch(spark, ("a", 1)), "r1", "2024-01-01T00:00:00")
    assert [r["run_id"] for r in one.dataset_runs().collect()] == ["r2"]
    assert [r["natural_key"] for r in one.records().collect()] == ["b"]


def test_open_membership_takes_the_newest_run(spark):
    runs = spark.createDataFrame(
        [("r1", "w1", "s1", "SUCCESS", None, "", "2024-01-01", "2024-01-01"), ("r2", "w2", "s2", "FAILED", None, "", "2024-01-02", "2024-01-02")],
        "run_id string, workflow_id string, source_id string, status string, assessment_status string, assessment_codes string, finished_at string, created_at string",
    )
    runs = runs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("finished_at", "created_at")})
    members = spark.createDataFrame([("a", None, None, True), ("b", "w1", None, True), ("c", None, "s9", True)], "source_key string, workflow_id string, source_id string, required boolean")
    written = spark.createDataFrame([("r1", 3), ("r2", 0)], "run_id string, observed_count long")
    got = {r["source_key"]: (r["run_id"], r["status"]) for r in views.coverage_sources(members, runs, written).collect()}
    assert got == {"a": ("r2", "FAIL"), "b": ("r1", "PASS"), "c": (None, "MISSING")}
