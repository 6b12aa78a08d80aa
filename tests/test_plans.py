"""Plans and skew: hot keys must not reach one task, results must equal brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import dedupe, frontier, ops
from gleaner.plans import ranking
from queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, rows=3000):
    rng = random.Random(7)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", rng.randrange(50), rng.randrange(4)) for i in range(rows)]
    return spark.createDataFrame(data, "id long, k string, t long, v long").repartition(8)


def test_first_per_key_limits_before_the_shuffle(spark):
    plan = plan_of(dedupe.keep_first(skewed(spark).withColumn("_seq", F.col("id")), ["k"]))
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[shuffle:] and "Partial" in plan[shuffle:]


def test_rate_limit_uses_group_limit(spark):
    df = skewed(spark).select(F.col("id").alias("request_id"), F.col("k").alias("token_id"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"))
    out = ops.rate_limit(df, 5)
    assert "WindowGroupLimit" in plan_of(out)
    accepted = {(r[0], r[1]): r[2] for r in out.where("accepted").groupBy("token_id", "bucket_start").count().collect()}
    total = {(r[0], r[1]): r[2] for r in out.groupBy("token_id", "bucket_start").count().collect()}
    assert accepted == {k: min(5, n) for k, n in total.items()}


def test_running_total_equals_global_window(spark):
    df = skewed(spark)
    got = ranking.running_total(df, ["t", "id"], F.col("v"), "s", partitions=5).select("id", "s")
    want = df.select("id", F.sum("v").over(Window.orderBy("t", "id")).alias("s"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_previous_value_equals_lag(spark, partitions):
    df = skewed(spark)
    got = ranking.previous_value(df, ["k"], ["t", "id"], "v", "p", partitions).select("id", "p")
    want = df.select("id", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")).alias("p"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_byte_budget(spark):
    df = skewed(spark)
    kept = frontier.budget_cutoff(df, "id", max_bytes=100, size="v").select("id", "v").collect()
    total, want = 0, set()
    for row in df.orderBy("id").collect():
        total += row["v"]
        if total > 100:
            break
        want.add(row["id"])
    assert {r["id"] for r in kept} == want


def test_crawl_closure_with_cycle_and_hub(spark):
    edges = [(0, i) for i in range(1, 500)] + [(i, 0) for i in range(1, 500)] + [(499, 1000), (1000, 1001), (1001, 499)]
    links = spark.createDataFrame(edges, "src long, dst long")
    got = {r["url"]: r["depth"] for r in frontier.crawl_closure(spark.createDataFrame([(0,)], "url long"), links).collect()}
    assert got[0] == 1 and got[499] == 2 and got[1000] == 3 and got[1001] == 4 and len(got) == 502
    few = frontier.crawl_closure(spark.createDataFrame([(0,)], "url long"), links, max_items=10)
    assert few.count() == 10


@pytest.mark.parametrize("name", ["view_current", "view_history", "upsert_classify", "coverage_sources", "filter_decisions", "content_links"])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["at_second"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_path_joins_are_cut_finely_until_the_next_query(spark):
    """A fixed number of ranges would give each task a share that grows with the pages."""
    from gleaner.operators import dom, structure
    from gleaner.session import INITIAL_PARTITIONS, tune

    tune(spark)
    pages = spark.createDataFrame([(1, "u", "<div><ul><li id=x>a<b>c</b></li></ul></div>")], "page_id long, url string, html string")
    found = structure.reach(dom.dom_nodes(pages), {"hit": structure.element("ul").child("li").descendant("b")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 2000), REPARTITION_BY_COL" in plan
    assert [(r["tag"], r["text"]) for r in found.collect()] == [("b", "c")]
    tune(spark)
    assert spark.conf.get(INITIAL_PARTITIONS, None) is None
