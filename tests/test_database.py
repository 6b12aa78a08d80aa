import uuid

import pytest
from pyspark.sql import functions as F

from gleaner.sources import database
from gleaner.sources.database import Target


@pytest.fixture
def target(spark):
    made = Target(f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", "OFFERS", schema="APP", options={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    with database.transaction(spark, made) as run:
        run('CREATE TABLE APP.OFFERS ("id" BIGINT NOT NULL, part VARCHAR(10) NOT NULL, price DOUBLE, note VARCHAR(20), PRIMARY KEY ("id", part))')
        run("INSERT INTO APP.OFFERS VALUES (1, 'a', 1.0, 'old'), (2, 'a', 2.0, 'kept')")
    return made


def rows(spark, target):
    return sorted(tuple(r) for r in target.read(spark).collect())


def offers(spark, values):
    return spark.createDataFrame(values, "id long, piece string, price double, extra int, seq int").repartition(4)


KEYS, NAMES = ("id", "part"), {"piece": "part"}


def test_upsert_updates_inserts_and_keeps_other_columns(spark, target):
    df = offers(spark, [(1, "a", 5.0, 0, 1), (1, "a", 6.0, 0, 2), (3, "b", None, 0, 1)])
    assert database.write(df, target, "r1", NAMES, KEYS, [F.col("seq")]) == 2
    want = [(1, "a", 6.0, "old"), (2, "a", 2.0, "kept"), (3, "b", None, None)]
    assert rows(spark, target) == want
    assert database.write(offers(spark, [(9, "z", 9.0, 0, 1)]), target, "r1", NAMES, KEYS) == 0
    assert rows(spark, target) == want and [tuple(r)[::2] for r in database.published(spark, target).collect()] == [("r1", 2)]


def test_half_failed_write_leaves_the_target(spark, target):
    before = rows(spark, target)
    bad = offers(spark, [(i, f"p{i}", 1.0, 0, 1) for i in range(40)] + [(99, "far too long for it", 1.0, 0, 1)])
    with pytest.raises(Exception):  # noqa: B017 - whatever the driver throws
        database.write(bad, target, "r2", NAMES, KEYS)
    assert rows(spark, target) == before and database.published(spark, target).count() == 0
    assert database.write(bad.where("id < 99"), target, "r2", NAMES, KEYS) == 40
    assert len(rows(spark, target)) == 42


def test_failure_while_publishing_rolls_back(spark, target, monkeypatch):
    df = offers(spark, [(1, "a", 5.0, 0, 1), (4, "c", 4.0, 0, 1)])
    database.prepare_ledger(spark, target)
    before, merge = rows(spark, target), database._merge
    with monkeypatch.context() as patch:
        patch.setattr(database, "LEDGER", "_gone")
        attempt, columns = database.stage(df, target, NAMES, KEYS)
        patch.setattr(database, "LEDGER", "_published")
        patch.setattr(database, "_merge", lambda *a: merge(*a) + " AND THEN FAIL")
        with pytest.raises(Exception):  # noqa: B017
            database.publish(spark, target, attempt, columns, "r3", KEYS)
    assert rows(spark, target) == before and database.published(spark, target).count() == 0
    assert database.publish(spark, target, attempt, columns, "r3", KEYS) == 2
    assert database.publish(spark, target, attempt, columns, "r3", KEYS) == 0
    database.drop_stage(spark, target, attempt)
    database.drop_stage(spark, target, attempt)


@pytest.mark.parametrize("keys", [KEYS, ()])
def test_a_task_that_ran_twice_counts_once(spark, target, monkeypatch, keys):
    fill = database.fill
    monkeypatch.setattr(database, "fill", lambda *a: (fill(*a), fill(*a)))
    df = offers(spark, [(7, "x", 1.0, 0, 1), (8, "x", 1.0, 0, 1)])
    assert database.write(df, target, "r4", NAMES, keys) == 2
    assert len(rows(spark, target)) == 4


def test_insert_keeps_equal_rows_and_stops_at_the_key(spark, target):
    with database.transaction(spark, target) as run:
        run("CREATE TABLE APP.LOG (line VARCHAR(10))")
    log = Target(target.url, "LOG", "APP", options=target.options)
    assert database.write(spark.createDataFrame([("a",), ("a",), ("b",)], "line string"), log, "r") == 3
    with pytest.raises(Exception):  # noqa: B017
        database.write(offers(spark, [(1, "a", 9.0, 0, 1)]), target, "r5", NAMES)
    assert (1, "a", 1.0, "old") in rows(spark, target)


def test_names_are_checked_and_unknown_columns_left_out(spark, target):
    with pytest.raises(ValueError, match="not allowed"):
        database.write(offers(spark, []), Target(target.url, "x; drop", "APP"), "r")
    with pytest.raises(ValueError, match="allow-list"):
        database.write(offers(spark, []), Target(target.url, "OFFERS", "APP", allowed=["OTHER"]), "r")
    with pytest.raises(ValueError, match="no column"):
        database.write(spark.createDataFrame([(1,)], "nothing int"), target, "r")
    assert database.write(offers(spark, []), target, "r6", NAMES, KEYS) == 0


def test_statements_of_other_engines():
    merge = lambda url, keys=("k",): database._merge(Target(url, "t"), "s", ["k", "v"], keys)
    assert merge("jdbc:postgresql://h/d") == (
        'INSERT INTO public.t ("k", "v") SELECT "k", "v" FROM s WHERE 1 = 1 ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"'
    )
    assert merge("jdbc:mysql://h/d") == "INSERT INTO public.t (`k`, `v`) SELECT `k`, `v` FROM s ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    assert merge("jdbc:postgresql://h/d", ("k", "v")).endswith("DO NOTHING") and merge("jdbc:oracle:x", ()).startswith("INSERT")
