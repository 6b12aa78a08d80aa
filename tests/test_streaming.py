"""The change feed in event order: late rows, ties, bounded state, and the events table in scrambled files."""

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import jobs


class Feed:
    def __init__(self, spark, folder, name, **settings):
        self.spark, self.folder, self.name = spark, str(folder / name), name
        spark.createDataFrame([], "k string, h string, ts timestamp").write.parquet(self.folder)
        stream = spark.readStream.schema("k string, h string, ts timestamp").parquet(self.folder)
        self.query = jobs.changed_payloads(stream, "k", "h", "ts", **settings).writeStream.format("memory").queryName(name).outputMode("update").start()

    def put(self, *rows):
        before = self.spark.table(self.name).count()
        df = self.spark.createDataFrame(rows, "k string, h string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(self.folder)
        self.query.processAllAvailable()
        return sorted(map(tuple, self.spark.table(self.name).collect()[before:]), key=str)


@pytest.fixture
def feed(spark, tmp_path):
    made = []

    def make(name, **settings):
        made.append(Feed(spark, tmp_path, name, **settings))
        return made[-1]

    yield make
    for f in made:
        f.query.stop()


def test_late_rows_change_nothing(feed):
    f = feed("late")
    assert f.put(("a", "2", "2024-01-01 00:01:00"), ("a", "1", "2024-01-01 00:00:00"), (None, "x", "2024-01-01 00:00:00")) == [("a", "2"), (None, "x")]
    assert f.put(("a", "1", "2024-01-01 00:00:30")) == []
    assert f.put(("a", "2", "2024-01-01 00:02:00")) == []
    assert f.put(("a", "9", "2024-01-01 00:01:30"), ("a", "3", "2024-01-01 00:03:00")) == [("a", "3")]
    assert f.put(("a", "1", "2024-01-01 00:03:00")) == []  # an equal order with a lesser digest
    assert f.put(("a", "4", "2024-01-01 00:03:00")) == [("a", "4")]


def test_state_is_bounded_by_event_time(feed):
    f = feed("bounded", delay="1 minute", idle="2 minutes")
    assert f.put(("a", "1", "2024-01-01 00:00:00"), ("b", "1", "2024-01-01 00:00:00")) == [("a", "1"), ("b", "1")]
    f.put(("b", "1", "2024-01-01 00:10:00"))
    f.put(("b", "1", "2024-01-01 00:11:00"))
    kept = f.query.lastProgress.stateOperators[0].numRowsTotal if f.query.lastProgress else None
    assert kept in (1, None)
    assert f.put(("a", "7", "2024-01-01 00:01:00")) == []  # before the watermark
    assert f.put(("a", "1", "2024-01-01 00:12:00")) == [("a", "1")]  # forgotten, so a first one


def test_a_delay_needs_a_time(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS k", "'b' AS h", "value AS n")
    with pytest.raises(ValueError, match="timestamp"):
        jobs.changed_payloads(stream, "k", "h", "n", delay="1 minute")


def test_events_in_scrambled_files_end_like_the_batch(spark, tmp_path):
    """Whatever the order of arrival, the last emitted digest of a key is that of its newest event."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").cast("string").alias("k"), F.floor(F.col("value") / 10).cast("string").alias("h"), F.col("event_id").alias("n")
    )
    source = str(tmp_path / "events")
    events.repartition(5, F.col("n") % 5).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.changed_payloads(stream, "k", "h", "n").writeStream.format("memory").queryName("scrambled").outputMode("update").start()
    try:
        query.processAllAvailable()
        emitted = [tuple(r) for r in spark.table("scrambled").collect()]
    finally:
        query.stop()
    newest = {r["k"]: r["h"] for r in events.groupBy("k").agg(F.max_by("h", "n").alias("h")).collect()}
    assert dict(emitted) == newest and len(emitted) >= len(newest)
