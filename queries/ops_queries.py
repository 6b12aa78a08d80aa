"""Run, queue and usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import dedupe, ops
from queries import derived
from queries.derived import STATE
from queries.process_queries import DOC_LINES_ORACLE, doc_lines
from queries.registry import Tables, query


def node_runs(t: Tables):
    """Order lines as node executions of the order's run."""
    kinds = F.array(*[F.lit(k) for k in ("start", "json_path", "transform", "extract_repeating_list", "validate", "parse_table", "output")])
    return t.lineitem.select(
        F.concat(F.lit("r"), "l_orderkey").alias("run_id"),
        F.get(kinds, (F.col("l_linenumber") - 1) % 7).alias("node_type"),
        (F.col("l_discount") == 0.1).alias("partial"),
        F.col("l_quantity").cast("bigint").alias("input_count"),
        F.when(F.col("l_quantity") < 3, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("output_count"),
        F.when(F.col("l_tax") == 0.08, F.lit("timeout")).alias("error"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("duration_ms"),
    )


NODE_RUNS = """
WITH node_runs AS (SELECT concat('r', l_orderkey) AS run_id,
  ['start', 'json_path', 'transform', 'extract_repeating_list', 'validate', 'parse_table', 'output'][(l_linenumber - 1) % 7 + 1] AS node_type,
  l_discount = 0.1 AS partial, CAST(l_quantity AS BIGINT) AS input_count, CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS output_count,
  CASE WHEN l_tax = 0.08 THEN 'timeout' END AS error, CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms FROM lineitem)
"""


@query(
    "run_status",
    NODE_RUNS
    + """, f AS (SELECT run_id, bool_or(partial) AS p, bool_or(node_type IN ('json_path', 'extract_repeating_list', 'parse_table') AND output_count = 0) AS e FROM node_runs GROUP BY run_id)
SELECT o.run_id, CASE WHEN k % 17 = 0 THEN 'FAILED' WHEN k % 11 = 0 THEN 'WAITING_FOR_REVIEW' WHEN coalesce(p, false) THEN 'PARTIAL_SUCCESS'
  WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'SUCCESS_EMPTY_ALLOWED' ELSE 'SUCCESS_EMPTY_UNEXPECTED' END
  WHEN coalesce(e, false) THEN 'SUCCESS_EMPTY_UNEXPECTED' ELSE 'SUCCESS' END AS status
FROM (SELECT concat('r', o_orderkey) AS run_id, o_orderkey AS k FROM orders) o LEFT JOIN f USING (run_id)""",
)
def run_status(t: Tables):
    k = F.col("o_orderkey")
    runs = t.orders.select(
        F.concat(F.lit("r"), k).alias("run_id"),
        (k % 17 == 0).alias("blocked"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("review_tasks"),
        (k % 5).alias("record_count"),
        F.when(k % 2 == 0, "allow").otherwise("warning").alias("on_empty"),
    )
    return ops.run_status(runs, node_runs(t))


@query(
    "stale_runs",
    """
WITH r AS (SELECT o_orderkey AS k, ['RUNNING', 'QUEUED', 'CANCEL_REQUESTED', 'SUCCESS'][o_orderkey % 4 + 1] AS status, o_orderdate AS lease,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - INTERVAL 100 SECOND END AS beat, o_orderdate + INTERVAL 30 DAY AS deadline FROM orders),
n AS (SELECT *, TIMESTAMP '1996-06-01 00:00:00' AS now FROM r)
SELECT concat('r', k) AS run_id,
  CASE WHEN status = 'RUNNING' AND lease < now AND (beat IS NULL OR beat < now - INTERVAL 120 SECOND) THEN 'FAILED'
    WHEN status IN ('QUEUED', 'RUNNING') AND deadline <= now THEN 'TIMED_OUT'
    WHEN status = 'CANCEL_REQUESTED' AND lease < now THEN 'CANCELLED' ELSE status END AS status,
  CASE WHEN status = 'RUNNING' AND lease < now AND (beat IS NULL OR beat < now - INTERVAL 120 SECOND) THEN 'RUN_LEASE_EXPIRED'
    WHEN status IN ('QUEUED', 'RUNNING') AND deadline <= now THEN 'RUN_DEADLINE_EXCEEDED' END AS error FROM n
""",
)
def stale_runs(t: Tables):
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in ("RUNNING", "QUEUED", "CANCEL_REQUESTED", "SUCCESS")])
    runs = t.orders.select(
        F.concat(F.lit("r"), k).alias("run_id"),
        F.get(states, (k % 4).cast("int")).alias("status"),
        F.col("o_orderdate").alias("lease_expires_at"),
        F.when(k % 3 != 0, F.expr("o_orderdate - interval 100 seconds")).alias("heartbeat_at"),
        F.expr("o_orderdate + interval 30 days").alias("deadline_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )
    now = F.lit("1996-06-01T00:00:00").cast("timestamp_ntz")
    return ops.reconcile_stale(runs, now, 120).select("run_id", "status", "error")


@query(
    "ops_dashboard",
    """SELECT count(*) AS total_runs, count(*) FILTER (o_orderstatus = 'O') AS failed_runs,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-07-30') AS success_24h,
  sum(o_orderkey % 3)::BIGINT AS pending_reviews, sum(o_orderkey % 5)::BIGINT AS changed_records FROM orders""",
)
def ops_dashboard(t: Tables):
    k = F.col("o_orderkey")
    runs = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING").alias("status"),
        F.col("o_orderdate").alias("finished_at"),
        (k % 3).alias("review_tasks"),
        (k % 5).alias("records_updated"),
    )
    return ops.dashboard(runs, F.lit("1998-07-31T00:00:00").cast("timestamp_ntz"))


@query(
    "node_stats",
    NODE_RUNS
    + """ SELECT node_type, count(*) AS executions, sum(input_count)::BIGINT AS input_count, sum(output_count)::BIGINT AS output_count, round(avg(duration_ms), 6) AS avg_ms,
  max(duration_ms) AS max_ms, count(*) FILTER (output_count = 0 AND error IS NULL) AS zero_outputs,
  CASE WHEN count(*) FILTER (output_count = 0 AND error IS NULL) > 0 THEN CASE node_type WHEN 'extract_repeating_list' THEN 'REPEATING_LIST_NO_MATCH' ELSE 'NODE_ZERO_OUTPUT' END END AS warning_code
FROM node_runs GROUP BY node_type""",
)
def node_stats(t: Tables):
    return ops.node_stats(node_runs(t))


@query(
    "node_diagnostics",
    NODE_RUNS
    + """ SELECT run_id, node_type, duration_ms, CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN error IS NULL AND output_count = 0 AND node_type <> 'output' THEN CASE node_type WHEN 'extract_repeating_list' THEN 'REPEATING_LIST_NO_MATCH' ELSE 'NODE_ZERO_OUTPUT' END END AS warning_code,
  CASE WHEN error IS NOT NULL THEN 'CHECK_CONFIGURATION' WHEN output_count = 0 AND node_type = 'extract_repeating_list' THEN 'CHECK_SELECTOR'
    WHEN output_count = 0 THEN 'CHECK_INPUT_PATH' END AS recommendation FROM node_runs""",
)
def node_diagnostics(t: Tables):
    rows = node_runs(t).withColumn("output_type", F.when(F.col("node_type") == "output", "DOCUMENT"))
    return ops.node_diagnostics(rows).select("run_id", "node_type", "duration_ms", "status", "warning_code", "recommendation")


@query(
    "node_percentiles",
    NODE_RUNS
    + """, b AS (SELECT node_type, duration_ms - duration_ms % CAST(10 ** greatest(length(duration_ms::VARCHAR) - 3, 0) AS BIGINT) AS v FROM node_runs)
SELECT node_type, count(*) AS executions, min(v) FILTER (i * 100 >= c * 50) AS p50_ms, min(v) FILTER (i * 100 >= c * 95) AS p95_ms, min(v) FILTER (i * 100 >= c * 99) AS p99_ms
FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY v) AS i, count(*) OVER (PARTITION BY node_type) AS c FROM b) GROUP BY node_type""",
)
def node_percentiles(t: Tables):
    """Histograms stored by run and node, merged by node."""
    by_run = ops.duration_histogram(node_runs(t), ("run_id", "node_type"))
    return ops.duration_percentiles(ops.merge_histograms(by_run))


@query(
    "run_list",
    NODE_RUNS
    + """, r AS (SELECT o_orderkey, concat('r', o_orderkey) AS run_id, o_custkey, o_orderdate, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, concat('r', o_orderkey) DESC LIMIT 200)
SELECT r.run_id, concat('w', o_custkey) AS workflow_id, any_value(c_name) AS workflow_name, any_value(o_orderstatus) AS status,
  CAST(any_value(o_orderdate) AS VARCHAR) AS created_at, count(n.run_id) AS nodes, count(n.error) AS failed_nodes, coalesce(sum(n.output_count), 0)::BIGINT AS output_count,
  CASE WHEN o_orderkey % 3 = 1 THEN 'E1' END AS error_code
FROM r JOIN customer ON c_custkey = o_custkey LEFT JOIN node_runs n USING (run_id) GROUP BY r.run_id, o_custkey, o_orderkey""",
)
def run_list(t: Tables):
    k = F.col("o_orderkey")
    runs = t.orders.select(
        F.concat(F.lit("r"), k).alias("run_id"),
        F.concat(F.lit("w"), "o_custkey").alias("workflow_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 3 == 1, F.lit('{"code": "E1"}')).when(k % 3 == 2, F.lit('{"code": ""}')).alias("error_json"),
    )
    workflows = t.customer.select(F.concat(F.lit("w"), "c_custkey").alias("workflow_id"), F.col("c_name").alias("name"))
    return ops.run_list(runs, workflows, node_runs(t), status="F").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "llm_usage",
    """SELECT role AS provider, concat('m', turn % 3) AS model, count(*) AS calls, sum(len(string_split(text, ' ')))::BIGINT AS input_tokens,
  sum(length(text))::BIGINT AS output_tokens, round(avg(length(text) * 2), 6) AS avg_latency_ms, round(sum(length(text) * 0.001::DOUBLE), 6) AS estimated_cost
FROM conversations GROUP BY ALL""",
)
def llm_usage(t: Tables):
    size = F.char_length("text").cast("bigint")
    calls = t.conversations.select(
        F.col("role").alias("provider"),
        F.concat(F.lit("m"), F.col("turn") % 3).alias("model"),
        F.size(F.split("text", " ")).cast("bigint").alias("input_tokens"),
        size.alias("output_tokens"),
        (size * 2).alias("latency_ms"),
        (size * F.lit(0.001)).alias("estimated_cost"),
    )
    return ops.model_usage(calls)


@query(
    "rate_limit",
    """SELECT event_id AS request_id, rn <= 1 AS accepted, CASE WHEN rn > 1 THEN greatest(CAST(floor(epoch(date_trunc('minute', ts) + INTERVAL 1 MINUTE - ts)) AS BIGINT), 1) END AS retry_after
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 2, date_trunc('minute', ts) ORDER BY ts, event_id) AS rn FROM events)""",
)
def rate_limit(t: Tables):
    requests = t.events.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 2).alias("token_id"), "ts")
    return ops.rate_limit(requests, 1).select("request_id", "accepted", "retry_after")


@query(
    "cron_calendar",
    """
WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS c, ['UTC', 'Europe/Berlin', 'Asia/Kathmandu'][s_suppkey % 3 + 1] AS tz FROM supplier WHERE s_suppkey % 10 <> 9),
m AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-29', TIMESTAMP '2024-04-01 23:59:00', INTERVAL 1 MINUTE)) AS moment),
z AS (SELECT moment, tz, (moment AT TIME ZONE 'UTC') AT TIME ZONE tz AS l FROM m, (SELECT DISTINCT tz FROM s))
SELECT s_suppkey AS schedule_id, CAST(moment AS VARCHAR) AS planned_at FROM s JOIN z USING (tz)
WHERE CASE c WHEN 0 THEN minute(l) % 20 = 0
  WHEN 1 THEN minute(l) = 0 AND hour(l) IN (6, 9, 12, 15, 18) AND dayofweek(l) BETWEEN 1 AND 5
  WHEN 2 THEN minute(l) = 30 AND hour(l) = 2 AND day(l) IN (1, 31) ELSE minute(l) IN (5, 35) AND hour(l) < 4 AND month(l) = 3 AND dayofweek(l) = 0 END
""",
)
def cron_calendar(t: Tables):
    k = F.col("s_suppkey")
    crons = ["*/20 * * * *", "0 6-18/3 * * 1-5", "30 2 1,31 * *", "5,35 0-3 * 3 0"]
    zones = ["UTC", "Europe/Berlin", "Asia/Kathmandu"]
    schedules = t.supplier.select(
        k.alias("schedule_id"),
        F.get(F.array(*[F.lit(c) for c in crons]), (k % 4).cast("int")).alias("cron"),
        F.get(F.array(*[F.lit(z) for z in zones]), (k % 3).cast("int")).alias("timezone"),
        (k % 10 != 9).alias("enabled"),
    )
    return ops.cron_occurrences(schedules, "2024-03-29T00:00:00", "2024-04-02T00:00:00").select(
        "schedule_id", F.col("planned_at").cast("string").alias("planned_at")
    )


@query(
    "cron_calendar_odd",
    """
WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS c, ['UTC', 'Europe/Berlin', 'Asia/Kathmandu'][s_suppkey % 3 + 1] AS tz FROM supplier WHERE s_suppkey % 4 <> 3),
m AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-29 00:07:00', TIMESTAMP '2024-03-29 01:02:00', INTERVAL 1 MINUTE)) AS moment
  UNION ALL SELECT TIMESTAMP '2024-03-30 05:41:00'),
z AS (SELECT moment, tz, (moment AT TIME ZONE 'UTC') AT TIME ZONE tz AS l FROM m, (SELECT DISTINCT tz FROM s))
SELECT s_suppkey AS schedule_id, CAST(moment AS VARCHAR) AS planned_at FROM s JOIN z USING (tz)
WHERE CASE c WHEN 0 THEN TRUE WHEN 1 THEN minute(l) % 7 = 0 ELSE minute(l) IN (26, 59) OR minute(l) BETWEEN 40 AND 48 END
""",
)
def cron_calendar_odd(t: Tables):
    """A window off the quarter hours and one of a single minute; schedules that allow nothing."""
    k = F.col("s_suppkey")
    crons = [F.when(k % 4 == 3, broken).otherwise(cron) for cron, broken in (("* * * * *", "*/0 * * * *"), ("*/7 * * * *", "*/x * * * *"), ("26,40-48,59 * * * *", "70 * * * *"))]
    zones = F.array(*[F.lit(z) for z in ("UTC", "Europe/Berlin", "Asia/Kathmandu")])
    schedules = t.supplier.select(
        k.alias("schedule_id"),
        F.get(F.array(*crons), (k % 3).cast("int")).alias("cron"),
        F.get(zones, (k % 3).cast("int")).alias("timezone"),
        F.lit(True).alias("enabled"),
    )
    windows = (("2024-03-29T00:07:00", "2024-03-29T01:03:00"), ("2024-03-30T05:41:00", "2024-03-30T05:42:00"))
    first, second = (ops.cron_occurrences(schedules, *w) for w in windows)
    return first.unionByName(second).select("schedule_id", F.col("planned_at").cast("string").alias("planned_at"))


@query(
    "batch_targets",
    """WITH w AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey)
SELECT concat('w', k) AS workflow_id, concat('s', s_suppkey) AS source_id, c_nationkey AS project_id FROM w JOIN supplier ON s_nationkey = c_nationkey
WHERE s_acctbal > 0 AND s_suppkey % 5 <> 0""",
)
def batch_targets(t: Tables):
    # The workflow that is due: one per project.
    due = t.customer.where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    workflows = due.select(F.concat(F.lit("w"), "k").alias("workflow_id"), F.col("c_nationkey").alias("project_id"))
    sources = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"),
        F.col("s_nationkey").alias("project_id"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        F.when(F.col("s_suppkey") % 5 != 0, "PUBLIC").otherwise("PRIVATE").alias("access"),
    )
    return ops.batch_targets(workflows, sources)


@query(
    "redact_text",
    """SELECT doc_id, sha256(replace(replace(replace(text, 'license', '[REDACTED]'), 'tion', '[REDACTED]'), 'the', '[REDACTED]')) AS text_sha,
  '[REDACTED]' AS token, CASE WHEN doc_id % 2 = 0 THEN '{"note":"[REDACTED]","password":"[REDACTED]","n":' || doc_id || '}' ELSE '{"Token" : "[REDACTED]"}' END AS payload FROM documents""",
)
def redact_text(t: Tables):
    secrets = ["the", "license", "tion", "x"]
    df = t.documents.select(
        "doc_id",
        "text",
        F.col("lang").alias("token"),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit('{"note":"the","password":"a\\"b","n":'), "doc_id", F.lit("}")),
        )
        .otherwise(F.lit('{"Token" : 12.5}'))
        .alias("payload"),
    )
    masked = ops.redact_frame(df.withColumn("payload", ops.redact_json_text(F.col("payload"), secrets)), secrets)
    return masked.select("doc_id", F.sha2("text", 256).alias("text_sha"), "token", "payload")


@query(
    "audit_recent",
    "SELECT event_id, user_id, event_type, CAST(ts AS VARCHAR) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def audit_recent(t: Tables):
    newest = dedupe.latest(t.events, [F.col("ts").desc(), F.col("event_id").desc()], 100)
    return newest.select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("at"))


@query(
    "emit_on_change",
    """SELECT event_id, user_id, event_type, bucket FROM (SELECT *, lag(bucket) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before
  FROM (SELECT *, CAST(floor(value / 10) AS BIGINT) AS bucket FROM events)) WHERE bucket IS DISTINCT FROM before""",
)
def emit_on_change(t: Tables):
    feed = t.events.select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 10).cast("bigint").alias("bucket"))
    return ops.changed_only(feed, ["user_id", "event_type"], ["ts", "event_id"], "bucket").select(
        "event_id", "user_id", "event_type", "bucket"
    )


@query(
    "fetch_attempts",
    DOC_LINES_ORACLE
    + """, a AS (SELECT concat('h', doc_id % 50) AS domain, CASE flag WHEN 'A' THEN 503 WHEN 'N' THEN 200 ELSE 429 END AS status, item AS n,
  count(*) OVER (PARTITION BY doc_id) - 1 AS last FROM lines)
SELECT domain, CAST(status AS BIGINT) AS status, count(*) AS attempts, count(*) FILTER (n < last AND status <> 200) AS retries,
  count(*) FILTER (n = last AND status = 200) AS succeeded, sum(CASE WHEN n < last AND status <> 200 THEN 0.5 * pow(2.0, n) ELSE 0 END)::DOUBLE AS backoff_seconds FROM a GROUP BY ALL
""",
)
def fetch_attempts(t: Tables):
    status = lambda x: F.when(x["flag"] == "A", 503).when(x["flag"] == "N", 200).otherwise(429).cast("bigint")
    attempts = F.transform("lines", lambda x: F.struct(status(x).alias("status"), F.lit(None).cast("string").alias("error")))
    fetches = doc_lines(t).select(
        F.col("doc_id").alias("url"), F.concat(F.lit("h"), F.col("doc_id") % 50).alias("domain"), attempts.alias("attempts")
    )
    return ops.fetch_rollup(fetches)


def streamed(t: Tables, job, mode: str = "append"):
    """Run a job over the events as a stream until all is read; its output as a table in the shared folder."""
    import uuid

    from gleaner.session import ensure_checkpoint_dir

    place = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    out = job(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{place}/rows")


@query("stream_unique", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, event_type AS natural_key FROM events")
def stream_unique(t: Tables):
    from gleaner.streaming import jobs

    named = lambda s: s.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("natural_key"), F.col("ts").alias("observed_at"))
    return streamed(t, lambda s: jobs.unique_observations(named(s))).select("run_id", "natural_key")


@query(
    "stream_rate_limit",
    """SELECT event_type, CAST(minute AS VARCHAR) AS minute, least(n, 2) AS accepted, greatest(n - 2, 0) AS rejected FROM (
  SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL) WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE""",
)
def stream_rate_limit(t: Tables):
    """Minutes that the watermark has closed."""
    from gleaner.streaming import jobs

    out = streamed(t, lambda s: jobs.requests_per_minute(s, 2, token="event_type"))
    return out.select("event_type", F.col("bucket_start").cast("string").alias("minute"), "accepted", "rejected")
