"""Headline queries on ``local[$BENCH_CPUS]``; prints one JSON line.

BENCH_SF_DIR     folder of the parquet tables (default sf0.1)
BENCH_CPUS       executor threads (default 8)
BENCH_QUERIES    comma-separated names, or "all"
BENCH_COMPARE=1  also time the DuckDB oracles (to stderr)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)

HEADLINE = """normalize_number normalize_term source_datetime clean_text select_by_rules filter_decisions
dedupe_first dedupe_decisions explode_items unpivot_matrix effective_revision assessment validate_schema
quarantine_split record_hash duplicate_keys version_numbers pending_fold upsert_counters review_apply
view_current view_history keyset_page_2 range_half_open coverage_sources run_status node_stats rate_limit
emit_on_change cron_calendar canonical_url url_frontier link_bfs budget_cutoff repeated_pages page_links
content_links repeating_list table_rows card_clusters article_record page_profile json_path
merge_url_lists""".split()


def session(cpus: str):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame) -> None:
    """Compute every row and column without a sink."""
    frame.write.format("noop").mode("overwrite").save()


def upsert_runs(spark, folder: str, count: int = 10) -> float:
    """The first ``count`` daily runs through the store, one after the other."""
    from pyspark.sql import functions as F

    from gleaner.sources.store import DatasetStore
    from queries.derived import incoming
    from queries.registry import Tables

    store = DatasetStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store", buckets=8)
    batches = incoming(Tables(spark, folder)).select("natural_key", "run_id", "data", "data_hash")
    started = time.perf_counter()
    for day in range(1, count + 1):
        run_id = f"2024-01-{day:02d}"
        store.commit(batches.where(F.col("run_id") == run_id).drop("run_id"), run_id, f"{run_id}T23:59:59")
    return time.perf_counter() - started


def keyset_walk(spark, folder: str, size: int = 500, pages: int = 20) -> float:
    """Twenty pages of the history view from its timeline; the timeline is built once before."""
    from queries.registry import Tables
    from queries.view_queries import tables
    from gleaner.operators import views
    from gleaner.sources import timeline

    view = views.history_view(*tables(Tables(spark, folder))).select("time", "stable_id", "natural_key", "version_number")
    line = timeline.build(view, tempfile.mkdtemp(prefix="spark-") + "/history")
    started, key = time.perf_counter(), None
    for _ in range(pages):
        page = line.page(size, key)
        key = page.next_key
        if key is None:
            break
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from queries import ORACLES, QUERIES
    from gleaner.session import tune

    spark = tune(session(cpus))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    run(spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count())
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    if not chosen:
        times["upsert_10_runs"] = round(upsert_runs(spark, folder), 3)
        times["keyset_walk_20x500"] = round(keyset_walk(spark, folder), 3)
    if os.environ.get("BENCH_COMPARE"):
        sys.path.insert(0, os.path.join(ROOT, "tests"))
        from oracle import connect

        con = connect(folder)
        for name in names:
            if name in ORACLES:
                started = time.perf_counter()
                con.execute(ORACLES[name]).fetchall()
                print(f"{name} spark={times[name]} duckdb={time.perf_counter() - started:.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
