from gleaner.operators import ops


def test_documents_and_failures_have_no_empty_warning(spark):
    rows = spark.createDataFrame(
        [
            (1, "parse_table", 0, None, None),
            (2, "extract_repeating_list", 0, None, None),
            (3, "parse_table", 0, "timeout", None),
            (4, "document", 0, None, "DOCUMENT"),
            (5, "parse_table", 3, None, None),
            (6, "parse_table", None, None, None),
        ],
        "id int, node_type string, output_count long, error string, output_type string",
    )
    got = {r["id"]: (r["status"], r["warning_code"], r["recommendation"]) for r in ops.node_diagnostics(rows).collect()}
    assert got == {
        1: ("SUCCESS", "NODE_ZERO_OUTPUT", "CHECK_INPUT_PATH"),
        2: ("SUCCESS", "REPEATING_LIST_NO_MATCH", "CHECK_SELECTOR"),
        3: ("FAILED", None, "CHECK_CONFIGURATION"),
        4: ("SUCCESS", None, "CHECK_INPUT_PATH"),
        5: ("SUCCESS", None, None),
        6: ("SUCCESS", "NODE_ZERO_OUTPUT", "CHECK_INPUT_PATH"),
    }


def test_percentiles_of_merged_histograms_are_within_a_per_cent(spark):
    values = [(k % 7, "a" if k % 3 else "b", (k * 7919) % 250000) for k in range(4000)] + [(0, "a", None), (1, "b", -5)]
    rows = spark.createDataFrame(values, "run_id int, node_type string, duration_ms long")
    by_run = ops.duration_histogram(rows, ("run_id", "node_type"))
    merged = ops.duration_percentiles(ops.merge_histograms(by_run))
    assert merged.orderBy("node_type").collect() == ops.duration_percentiles(ops.duration_histogram(rows)).orderBy("node_type").collect()
    for row in merged.collect():
        own = sorted(max(d, 0) for _, n, d in values if n == row["node_type"] and d is not None)
        assert row["executions"] == len(own)
        for share in (50, 95, 99):
            exact = own[-(-len(own) * share // 100) - 1]
            assert exact * 0.99 <= row[f"p{share}_ms"] <= exact


def test_run_list_without_runs_or_nodes(spark):
    runs = spark.createDataFrame(
        [("r1", "w1", "FAILED", 5, '{"code": "X"}'), ("r2", "w1", "SUCCESS", 5, None), ("r3", "gone", "SUCCESS", 9, None)],
        "run_id string, workflow_id string, status string, created_at int, error_json string",
    )
    workflows = spark.createDataFrame([("w1", "one")], "workflow_id string, name string")
    nodes = spark.createDataFrame([("r1", None, 4), ("r1", "e", 0)], "run_id string, error string, output_count long")
    got = sorted(tuple(r) for r in ops.run_list(runs, workflows, nodes).collect())
    assert got == [("r1", "w1", "one", "FAILED", 5, 2, 1, 4, "X"), ("r2", "w1", "one", "SUCCESS", 5, 0, 0, 0, None)]
    assert [r["run_id"] for r in ops.run_list(runs, workflows, nodes, limit=1).collect()] == ["r2"]
    assert ops.run_list(runs.limit(0), workflows, nodes).count() == 0


def test_cron_work_is_that_of_distinct_rules(spark):
    rows = spark.range(500).selectExpr("id AS schedule_id", "IF(id % 5 = 0, '7 3 * * *', '*/30 4 * * *') AS cron", "'Asia/Kathmandu' AS timezone", "id % 5 < 2 AS enabled")
    found = ops.cron_occurrences(rows, "2024-01-01T00:00:00", "2024-01-03T00:00:00")
    got = found.groupBy("planned_at").count().orderBy("planned_at").collect()
    days = ("2024-01-01", "2024-01-02")
    assert [(str(r[0]), r[1]) for r in got] == [(f"{d} {h}", 100) for d in days for h in ("21:22:00", "22:15:00", "22:45:00")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Rules are made distinct before they are expanded.
    assert plan.index("Generate explode") < plan.rindex("Aggregate [cron")
