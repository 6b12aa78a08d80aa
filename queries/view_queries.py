"""Dataset views, ranges, pages, summary and coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.operators import dataset, dedupe, review, views
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources import timeline
from queries import derived
from queries.derived import STATE
from queries.registry import Tables, query

LATEST = """, latest AS (SELECT * FROM (SELECT natural_key, version_number, observation_id, run_id AS obs_run, source_published_at, fetched_at, observed_at,
  row_number() OVER (PARTITION BY natural_key, version_number ORDER BY observed_at DESC, observation_id DESC) AS rn FROM observations) WHERE rn = 1),
current_view AS (SELECT r.*, l.observation_id, l.obs_run, l.source_published_at, l.fetched_at, l.observed_at
  FROM records r JOIN versions v ON v.natural_key = r.natural_key AND v.version_number = r.current_version
  LEFT JOIN latest l ON l.natural_key = r.natural_key AND l.version_number = r.current_version
  WHERE r.status = 'ACTIVE' AND r.review_status = 'APPROVED'),
history AS (SELECT o.*, v.review_status AS version_status FROM observations o JOIN versions v ON v.natural_key = o.natural_key AND v.version_number = o.version_number
  JOIN records r ON r.natural_key = o.natural_key WHERE v.review_status = 'APPROVED')
"""


def tables(t: Tables):
    seen = derived.observations(t)
    content = derived.versions(t, seen)
    return derived.records(t, content), content, seen


def current(t: Tables, basis: str = "observed_at"):
    return views.current_view(*tables(t), time_basis=basis)


def text(name: str):
    return F.col(name).cast("string").alias(name)


@query(
    "view_current",
    STATE + LATEST + " SELECT natural_key, current_version, data, observation_id, CAST(observed_at AS VARCHAR) AS time FROM current_view",
)
def view_current(t: Tables):
    return current(t).select("natural_key", "current_version", "data", "observation_id", text("time"))


@query(
    "view_history",
    STATE + LATEST + " SELECT observation_id, natural_key, version_number, content_changed, CAST(fetched_at AS VARCHAR) AS time FROM history",
)
def view_history(t: Tables):
    return views.history_view(*tables(t), time_basis="fetched_at").select(
        "observation_id", "natural_key", "version_number", "content_changed", text("time")
    )


@query(
    "view_run",
    STATE + LATEST + " SELECT observation_id, natural_key, version_number FROM history WHERE run_id = '2024-01-10'",
)
def view_run(t: Tables):
    return views.history_view(*tables(t), run_id="2024-01-10").select("observation_id", "natural_key", "version_number")


@query(
    "view_latest_run",
    STATE
    + LATEST
    + """, events_by_day AS (SELECT concat('', CAST(ts AS DATE)) AS run_id, ts FROM events),
day_runs AS (SELECT run_id, max(ts) AS finished_at FROM events_by_day GROUP BY run_id),
pick AS (SELECT run_id FROM day_runs WHERE substr(run_id, 10, 1) <> '0' AND run_id <> (SELECT max(run_id) FROM day_runs) ORDER BY finished_at DESC LIMIT 1)
SELECT observation_id, natural_key, version_number FROM history WHERE run_id = (SELECT run_id FROM pick)""",
)
def view_latest_run(t: Tables):
    day_runs = (
        t.events.groupBy(F.col("ts").cast("date").cast("string").alias("run_id"))
        .agg(F.max("ts").alias("finished_at"))
        .withColumn("created_at", F.col("finished_at"))
    )
    newest = day_runs.agg(F.max("run_id").alias("newest"))
    # One aggregated row, so this broadcast is bounded.
    runs = day_runs.join(F.broadcast(newest)).withColumn(
        "status",
        F.when(F.substring("run_id", 10, 1) == "0", "FAILED")
        .when(F.col("run_id") == F.col("newest"), "RUNNING")
        .otherwise("PARTIAL_SUCCESS"),
    )
    return views.latest_run_view(runs, *tables(t)).select("observation_id", "natural_key", "version_number")


@query(
    "range_half_open",
    STATE + LATEST + " SELECT observation_id, CAST(source_published_at AS VARCHAR) AS time FROM history WHERE source_published_at >= TIMESTAMP '2024-01-05 00:00:00' AND source_published_at < TIMESTAMP '2024-01-09 00:00:00'",
)
def range_half_open(t: Tables):
    view = views.history_view(*tables(t), time_basis="source_published_at")
    return views.time_range(view, "2024-01-05T00:00:00", "2024-01-09T00:00:00").select("observation_id", text("time"))


@query(
    "at_second",
    "SELECT event_id, CAST(ts AS VARCHAR) AS time FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:07' AND ts < TIMESTAMP '2024-01-01 00:00:08'",
)
def at_second(t: Tables):
    df = t.events.select("event_id", F.col("ts").alias("time"))
    return views.at_second(df, "2024-01-01T00:00:07.179").select("event_id", text("time"))


PAGED = """, keyed AS (SELECT observation_id AS stable_id, source_published_at AS t, CASE WHEN source_published_at IS NULL THEN 1 ELSE 0 END AS null_rank FROM current_view)"""


@query(
    "keyset_page_1",
    STATE + LATEST + PAGED + " SELECT stable_id, CAST(t AS VARCHAR) AS time FROM keyed ORDER BY null_rank, t DESC, stable_id DESC LIMIT 101",
)
def keyset_page_1(t: Tables):
    return views.keyset_rows(current(t, "source_published_at"), 101).select("stable_id", text("time"))


@query(
    "keyset_page_2",
    STATE
    + LATEST
    + PAGED
    + """ SELECT stable_id, CAST(t AS VARCHAR) AS time FROM keyed WHERE null_rank > 0 OR t < TIMESTAMP '2024-01-29 12:00:00'
  OR (t = TIMESTAMP '2024-01-29 12:00:00' AND stable_id < 'x') ORDER BY null_rank, t DESC, stable_id DESC LIMIT 101""",
)
def keyset_page_2(t: Tables):
    after = views.PageKey("2024-01-29T12:00:00", "x")
    return views.keyset_rows(current(t, "source_published_at"), 101, after).select("stable_id", text("time"))


def timed(t: Tables):
    """The current view as a timeline, in the folder that the cluster shares."""
    place = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/timeline-{uuid.uuid4().hex}"
    return timeline.build(current(t, "source_published_at").select("stable_id", "time", "natural_key"), place)


@query(
    "timeline_page_2",
    STATE
    + LATEST
    + PAGED
    + """ SELECT stable_id, CAST(t AS VARCHAR) AS time FROM keyed WHERE null_rank > 0 OR t < TIMESTAMP '2024-01-29 12:00:00'
  OR (t = TIMESTAMP '2024-01-29 12:00:00' AND stable_id < 'x') ORDER BY null_rank, t DESC, stable_id DESC LIMIT 101""",
)
def timeline_page_2(t: Tables):
    return timed(t).page_rows(101, views.PageKey("2024-01-29T12:00:00", "x")).select("stable_id", text("time"))


@query(
    "timeline_files",
    STATE
    + LATEST
    + PAGED
    + """ SELECT null_rank > 0 AS undated, count(*) AS rows, CAST(min(t) AS VARCHAR) AS first, CAST(max(t) AS VARCHAR) AS last FROM keyed GROUP BY null_rank""",
)
def timeline_files(t: Tables):
    """What the list of files says of the whole view."""
    said = timed(t).files().groupBy("undated").agg(F.sum("rows").alias("rows"), F.min("first_time").alias("f"), F.max("last_time").alias("l"))
    return said.select("undated", "rows", text("f").alias("first"), text("l").alias("last"))


@query(
    "record_item",
    STATE
    + LATEST
    + """ SELECT natural_key, data, CAST(observed_at AS VARCHAR) AS observed_at, CAST(source_published_at AS VARCHAR) AS source_published_at,
  obs_run AS run_id, current_version AS version, confidence, review_status FROM current_view""",
)
def record_item(t: Tables):
    return views.record_item(current(t)).select(
        "natural_key",
        "data",
        F.col("timestamps.observed_at").cast("string").alias("observed_at"),
        F.col("timestamps.source_published_at").cast("string").alias("source_published_at"),
        "provenance.run_id",
        "provenance.version",
        "confidence",
        "review_status",
    )


@query(
    "dataset_summary",
    STATE
    + """ SELECT count(*) FILTER (status = 'ACTIVE' AND review_status = 'APPROVED') AS approved, count(*) FILTER (status = 'ACTIVE' AND review_status = 'PENDING') AS pending,
  count(*) FILTER (review_status = 'REJECTED') AS rejected, count(*) FILTER (status = 'ACTIVE' AND review_status = 'PENDING' AND current_version = 1) AS pending_initial FROM records""",
)
def dataset_summary(t: Tables):
    return views.dataset_summary(tables(t)[0])


@query(
    "record_history",
    STATE + " SELECT natural_key, version_number, data, run_id FROM versions WHERE user_id = 7",
)
def record_history(t: Tables):
    return views.record_history(tables(t)[1], F.col("user_id") == 7).select(
        "natural_key", "version_number", "data", "run_id"
    )


COVERAGE = """
WITH runs AS (SELECT concat('r', o_orderkey) AS run_id, concat('w', o_custkey % 10) AS workflow_id, concat('s', o_custkey % 40) AS source_id,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'PARTIAL_SUCCESS' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'PARTIAL' ELSE 'PASS' END AS assessment_status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'EMPTY_VALID_WINDOW' ELSE '' END AS assessment_codes,
  o_orderdate AS created_at, o_orderdate + INTERVAL 1 HOUR AS finished_at, o_orderkey % 100 AS observed_count FROM orders WHERE o_orderkey % 7 <> 0),
w AS (SELECT * FROM runs WHERE finished_at >= TIMESTAMP '1995-01-01' AND finished_at < TIMESTAMP '1996-01-01'),
m AS (SELECT concat('n', n_nationkey) AS source_key, n_regionkey <> 4 AS required, CASE WHEN n_nationkey % 3 = 0 THEN concat('w', n_nationkey) END AS workflow_id,
  concat('s', n_nationkey * 2) AS source_id FROM nation),
j AS (SELECT m.source_key, m.required, w.*, row_number() OVER (PARTITION BY source_key ORDER BY finished_at DESC, created_at DESC, run_id DESC) AS rn
  FROM m LEFT JOIN w ON CASE WHEN m.workflow_id IS NOT NULL THEN w.workflow_id = m.workflow_id ELSE w.source_id = m.source_id END),
s AS (SELECT source_key, required, run_id,
  CASE WHEN run_id IS NULL THEN 'MISSING' WHEN status = 'SUCCESS' AND assessment_status <> 'PARTIAL' THEN 'PASS' WHEN status IN ('SUCCESS', 'PARTIAL_SUCCESS') THEN 'PARTIAL' ELSE 'FAIL' END AS state,
  CASE WHEN run_id IS NULL THEN 'SOURCE_NOT_CHECKED' WHEN status = 'SUCCESS' AND assessment_status <> 'PARTIAL' THEN assessment_codes
    WHEN status IN ('SUCCESS', 'PARTIAL_SUCCESS') THEN CASE WHEN assessment_codes <> '' THEN assessment_codes ELSE 'PARTIAL_RUN' END ELSE status END AS codes,
  coalesce(observed_count, 0) AS record_count, finished_at FROM j WHERE rn = 1)
"""


def coverage(t: Tables):
    key = F.col("o_orderkey")
    runs = derived.runs(t).where(key % 7 != 0).withColumns(
        {
            "assessment_status": F.when(key % 3 == 0, "PARTIAL").otherwise("PASS"),
            "assessment_codes": F.when(key % 5 == 0, "EMPTY_VALID_WINDOW").otherwise(""),
        }
    )
    done = runs.select("run_id", (key % 100).alias("observed_count"))
    n = F.col("n_nationkey")
    memberships = t.nation.select(
        F.concat(F.lit("n"), n).alias("source_key"),
        (F.col("n_regionkey") != 4).alias("required"),
        F.when(n % 3 == 0, F.concat(F.lit("w"), n)).alias("workflow_id"),
        F.concat(F.lit("s"), n * 2).alias("source_id"),
    )
    return views.coverage_sources(memberships, runs, done, "1995-01-01T00:00:00", "1996-01-01T00:00:00")


@query(
    "coverage_sources",
    COVERAGE
    + " SELECT source_key, required, run_id, state AS status, codes, record_count, CASE WHEN contains(codes, 'EMPTY_VALID_WINDOW') THEN 'EMPTY_VALID_WINDOW' END AS empty_reason, CAST(finished_at AS VARCHAR) AS finished_at FROM s",
)
def coverage_sources(t: Tables):
    return coverage(t).withColumn("finished_at", F.col("finished_at").cast("string"))


@query(
    "coverage_status",
    COVERAGE
    + """, a AS (SELECT count(*) AS e, count(*) FILTER (state <> 'MISSING') AS c, count(*) FILTER (state = 'PASS') AS p, count(*) FILTER (state = 'PARTIAL') AS q,
  count(*) FILTER (state IN ('FAIL', 'MISSING')) AS f FROM s WHERE required)
SELECT e AS expected_sources, c AS checked_sources, p AS successful_sources, q AS partial_sources, f AS failed_sources,
  CASE WHEN p = e THEN 'PASS' WHEN p > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM a""",
)
def coverage_status(t: Tables):
    return views.coverage_status(coverage(t))


@query(
    "project_scope",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3
UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)""",
)
def project_scope(t: Tables):
    owned = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("project_id"))
    member = t.customer.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("project_id"))
    return views.in_scope(t.orders, "o_custkey", owned, member).select("o_orderkey")


@query(
    "top_k_runs",
    "SELECT concat('r', o_orderkey) AS run_id, CAST(o_orderdate AS VARCHAR) AS created_at FROM orders ORDER BY o_orderdate DESC, concat('r', o_orderkey) DESC LIMIT 200",
)
def top_k_runs(t: Tables):
    newest = dedupe.latest(derived.runs(t), [F.col("created_at").desc(), F.col("run_id").desc()], 200)
    return newest.select("run_id", text("created_at"))


@query("approved_export", STATE + " SELECT natural_key, data FROM records WHERE status = 'ACTIVE' AND review_status = 'APPROVED'")
def approved_export(t: Tables):
    records, _, _ = tables(t)
    return views.approved_export(records).select("natural_key", "data")


@query("clear_dataset", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '2-HIGH'")
def clear_dataset(t: Tables):
    named = t.orders.withColumn("dataset_id", F.col("o_orderpriority"))
    return review.clear_dataset(named, "2-HIGH").select("o_orderkey", "o_orderpriority")


@query(
    "output_preflight",
    """SELECT unnest(['ASSESSMENT_BLOCKED', 'MAPPING_REQUIRED', 'MINIMUM_EXPECTED_RECORDS']) AS code, n FROM (SELECT count(*) AS n FROM orders)""",
)
def output_preflight(t: Tables):
    total = t.orders.count()
    codes = dataset.preflight(t.orders, business_records=False, commit_allowed=False, minimum=total + 1)
    return t.orders.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"), "n")


@query(
    "store_two_runs",
    """SELECT 'r1' AS run_id, count(*) AS created, 0::BIGINT AS updated, 0::BIGINT AS unchanged FROM customer
UNION ALL SELECT 'r2', count(*) FILTER (c_custkey % 5 = 0), count(*) FILTER (c_custkey % 3 = 0 AND c_custkey % 5 > 0), count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 5 > 0) FROM customer WHERE c_custkey % 7 > 0""".replace(
        "SELECT 'r1' AS run_id, count(*) AS created", "SELECT 'r1' AS run_id, count(*) FILTER (c_custkey % 5 > 0) AS created"
    ),
)
def store_two_runs(t: Tables):
    """Two runs and a repeated one committed to a store in the shared folder."""
    from gleaner.sources.store import DatasetStore

    store = DatasetStore(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}", 4)
    key = F.col("c_custkey")

    def rows(run: int):
        value = F.when((key % 3 == 0) & F.lit(run == 2), "new").otherwise("old")
        chosen = t.customer.where(key % 5 > 0) if run == 1 else t.customer.where(key % 7 > 0)
        return chosen.select(key.cast("string").alias("natural_key"), F.to_json(F.struct(value.alias("v"))).alias("data"), F.sha2(value, 256).alias("data_hash"))

    for run in (1, 2, 2):
        store.commit(rows(run), f"r{run}", f"2024-01-0{run}T00:00:00", {})
    return store.dataset_runs().select("run_id", "created", "updated", "unchanged")
