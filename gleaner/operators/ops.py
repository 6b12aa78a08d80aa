"""Run, queue and usage analytics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.binding import let
from gleaner.plans.ranking import nth_per_key, previous_value

REDACTED = "[REDACTED]"

# Field names whose value is always masked.
SENSITIVE_KEYS = (
    "api_key",
    "apikey",
    "authorization",
    "cookie",
    "cookies",
    "encrypted_password",
    "encrypted_value",
    "encrypted_storage_state",
    "password",
    "proxy_authorization",
    "secret",
    "secrets",
    "storage_state",
    "token",
)

# Node types whose empty result makes a run suspicious.
EXTRACTORS = ("json_path", "select_elements", "extract_repeating_list", "parse_table", "follow_links", "crawl_links")


def run_status(runs: DataFrame, node_runs: DataFrame) -> DataFrame:
    """``runs(run_id, blocked, review_tasks, record_count, on_empty)`` and
    ``node_runs(run_id, node_type, partial, output_count)`` to a terminal status."""
    facts = node_runs.groupBy("run_id").agg(
        F.bool_or("partial").alias("any_partial"),
        F.bool_or(F.col("node_type").isin(*EXTRACTORS) & (F.col("output_count") == 0)).alias("empty_extractor"),
    )
    joined = runs.join(facts, "run_id", "left")
    empty = F.when(F.col("on_empty") == "allow", "SUCCESS_EMPTY_ALLOWED").otherwise("SUCCESS_EMPTY_UNEXPECTED")
    status = (
        F.when(F.col("blocked"), "FAILED")
        .when(F.col("review_tasks") > 0, "WAITING_FOR_REVIEW")
        .when(F.coalesce("any_partial", F.lit(False)), "PARTIAL_SUCCESS")
        .when(F.col("record_count") == 0, empty)
        .when(F.coalesce("empty_extractor", F.lit(False)), "SUCCESS_EMPTY_UNEXPECTED")
        .otherwise("SUCCESS")
    )
    return joined.select("run_id", status.alias("status"))


def reconcile_stale(runs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Abandoned, overdue and cancelled runs get their terminal state, in that order."""
    grace = now - F.make_dt_interval(secs=F.lit(lease_seconds))
    abandoned = (
        (F.col("status") == "RUNNING")
        & (F.col("lease_expires_at") < now)
        & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < grace))
    )
    overdue = F.col("status").isin("QUEUED", "RUNNING") & (F.col("deadline_at") <= now)
    cancelled = (F.col("status") == "CANCEL_REQUESTED") & (
        F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    )
    verdict = (
        F.when(abandoned, F.struct(F.lit("FAILED").alias("status"), F.lit("RUN_LEASE_EXPIRED").alias("error")))
        .when(overdue, F.struct(F.lit("TIMED_OUT").alias("status"), F.lit("RUN_DEADLINE_EXCEEDED").alias("error")))
        .when(cancelled, F.struct(F.lit("CANCELLED").alias("status"), F.lit(None).cast("string").alias("error")))
    )
    marked = runs.withColumn("__verdict", verdict)
    ended = F.col("__verdict").isNotNull()
    return marked.withColumns(
        {
            "status": F.coalesce(F.col("__verdict.status"), F.col("status")),
            "error": F.col("__verdict.error"),
            "finished_at": F.when(ended, now).otherwise(F.col("finished_at")),
            "lease_expires_at": F.when(~ended, F.col("lease_expires_at")),
        }
    ).drop("__verdict")


def dashboard(runs: DataFrame, now: Column) -> DataFrame:
    """All totals of the operations page in one pass."""
    recent = F.col("finished_at") >= now - F.expr("interval 24 hours")
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_runs"),
        F.count_if((F.col("status") == "SUCCESS") & recent).alias("success_24h"),
        F.coalesce(F.sum("review_tasks"), F.lit(0)).alias("pending_reviews"),
        F.coalesce(F.sum("records_updated"), F.lit(0)).alias("changed_records"),
    )


def node_stats(node_runs: DataFrame) -> DataFrame:
    """Counts, duration spread and zero-output warnings per node type."""
    zero = (F.col("output_count") == 0) & F.col("error").isNull()
    code = F.when(F.col("node_type") == "extract_repeating_list", "REPEATING_LIST_NO_MATCH").otherwise("NODE_ZERO_OUTPUT")
    stats = node_runs.groupBy("node_type").agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum("input_count").alias("input_count"),
        F.sum("output_count").alias("output_count"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.count_if(zero).alias("zero_outputs"),
    )
    return stats.withColumn("warning_code", F.when(F.col("zero_outputs") > 0, code))


def node_diagnostics(node_runs: DataFrame) -> DataFrame:
    """Each execution with ``status``, ``warning_code`` and ``recommendation``.

    An execution that failed, or gave a document (``output_type`` or ``document_diagnostics``,
    both optional columns), has no warning for an empty result; a failed one is recommended to
    have its configuration checked.
    """
    failed = F.col("error").isNotNull()
    empty = F.coalesce(F.col("output_count"), F.lit(0)) == 0
    document = F.lit(False)
    if "output_type" in node_runs.columns:
        document = document | F.col("output_type").eqNullSafe("DOCUMENT")
    if "document_diagnostics" in node_runs.columns:
        document = document | F.coalesce("document_diagnostics", F.lit(False))
    listed = F.col("node_type") == "extract_repeating_list"
    warning = F.when(listed, "REPEATING_LIST_NO_MATCH").otherwise("NODE_ZERO_OUTPUT")
    advice = F.when(failed, "CHECK_CONFIGURATION").when(empty & listed, "CHECK_SELECTOR").when(empty, "CHECK_INPUT_PATH")
    return node_runs.withColumns(
        {
            "status": F.when(failed, "FAILED").otherwise("SUCCESS"),
            "warning_code": F.when(~failed & empty & ~document, warning),
            "recommendation": advice,
        }
    )


def duration_histogram(node_runs: DataFrame, keys: Sequence[str] = ("node_type",), duration: str = "duration_ms") -> DataFrame:
    """``n`` executions by ``keys`` and ``bucket``, the duration cut to three leading digits.

    A bucket is at most one per cent wide and a decade has 900 of them, so a histogram is small
    whatever the number of executions.  Histograms of runs, days or nodes are merged by adding
    ``n`` up, so they may be stored a run and never computed again.  Null durations count
    nowhere, negative ones as zero.
    """
    value = F.greatest(F.col(duration).cast("bigint"), F.lit(0))
    width = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("bigint")
    rows = node_runs.where(F.col(duration).isNotNull())
    return rows.groupBy(*keys, (value - value % width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(histograms: DataFrame, keys: Sequence[str] = ("node_type",)) -> DataFrame:
    """Histograms of finer keys, or of several runs, as one of ``keys``."""
    return histograms.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def duration_percentiles(
    histogram: DataFrame, keys: Sequence[str] = ("node_type",), shares: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """``executions`` and ``p50_ms`` …: the least bucket that reaches the share, in per cent, of all executions."""
    group = Window.partitionBy(*keys)  # the buckets of one key, some thousands at most
    reached = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = histogram.withColumns({"__reached": reached, "__total": F.sum("n").over(group)})
    return rows.groupBy(*keys).agg(
        F.max("__total").alias("executions"),
        *[F.min(F.when(F.col("__reached") * 100 >= F.col("__total") * p, F.col("bucket"))).alias(f"p{p}_ms") for p in shares],
    )


def run_list(
    runs: DataFrame, workflows: DataFrame, node_runs: DataFrame, workflow: str | None = None, status: str | None = None, limit: int = 200
) -> DataFrame:
    """The newest runs of known workflows with their name, node counts and error code.

    Node executions are counted for the listed runs only, at most ``limit`` of them, which is
    the bound of what is broadcast.  An empty error code is none.
    """
    rows = runs.join(workflows.select("workflow_id", F.col("name").alias("workflow_name")), "workflow_id")
    if workflow is not None:
        rows = rows.where(F.col("workflow_id") == workflow)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    newest = rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)
    counts = (
        node_runs.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.count_if(F.col("error").isNotNull()).alias("failed_nodes"),
            F.sum("output_count").alias("output_count"),
        )
    )
    code = F.get_json_object("error_json", "$.code")
    return newest.join(counts, "run_id", "left").select(
        "run_id",
        "workflow_id",
        "workflow_name",
        "status",
        "created_at",
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
        F.coalesce("failed_nodes", F.lit(0)).alias("failed_nodes"),
        F.coalesce("output_count", F.lit(0)).alias("output_count"),
        F.when(code != "", code).alias("error_code"),
    )


def model_usage(calls: DataFrame) -> DataFrame:
    """Call log rolled up by provider and model."""
    return calls.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.sum("estimated_cost"), 6).alias("estimated_cost"),
    )


def rate_limit(requests: DataFrame, limit: int, token: str = "token_id", time: str = "ts", ident: str = "request_id") -> DataFrame:
    """Fixed UTC minute per token: ``accepted`` and ``retry_after`` seconds.

    The last accepted request of each full minute is found with a group limit
    before the shuffle; only full minutes are joined back, so a token that sends a
    third of all requests is never gathered in one task.
    """
    minute = F.date_trunc("MINUTE", F.col(time)).cast("timestamp_ntz")
    rows = requests.withColumn("bucket_start", minute)
    last = nth_per_key(rows, [token, "bucket_start"], [F.col(time), F.col(ident)], max(limit, 1))
    cut = last.select(token, "bucket_start", F.struct(F.col(time).alias("t"), F.col(ident).alias("i")).alias("__cut"))
    joined = rows.join(cut, [token, "bucket_start"], "left")
    here = F.struct(F.col(time).alias("t"), F.col(ident).alias("i"))
    rejected = F.coalesce(here > F.col("__cut"), F.lit(False))
    left = F.timestamp_diff("SECOND", F.col(time), F.col("bucket_start") + F.expr("interval 1 minute"))
    return joined.withColumns(
        {"accepted": ~rejected, "retry_after": F.when(rejected, F.greatest(left, F.lit(1)).cast("bigint"))}
    ).drop("__cut")


def cron_values(field: Column, low: int, high: int) -> Column:
    """Numbers a cron field allows: lists, ranges, steps, ``*``."""

    def expand(token: Column) -> Column:
        body = F.trim(F.substring_index(token, "/", 1))
        # A step that is no positive number allows nothing.
        step = F.when(token.contains("/"), F.substring_index(token, "/", -1).try_cast("int")).otherwise(F.lit(1))
        step = F.when(step > 0, step)
        first = F.when(body == "*", F.lit(low)).otherwise(F.substring_index(body, "-", 1).try_cast("int"))
        last = F.when(body == "*", F.lit(high)).otherwise(F.substring_index(body, "-", -1).try_cast("int"))
        return F.when((first <= last) & step.isNotNull(), F.sequence(first, last, step)).otherwise(F.array().cast("array<int>"))

    values = F.flatten(F.transform(F.split(field, ","), expand))
    return F.array_distinct(F.filter(values, lambda v: v.between(low, high)))


def cron_occurrences(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """One row per (schedule, matching minute) in ``[start, end)``, UTC.

    Zones shift by quarter hours, so each distinct (cron, timezone) is expanded to quarter hours,
    checked in local time, and only then to its minutes; schedules that share both meet its minutes
    in a join, whose rows are the result's.
    """
    parts = F.split(F.trim(F.col("cron")), " +")
    fields = {"minutes": (0, 0, 59), "hours": (1, 0, 23), "days": (2, 1, 31), "months": (3, 1, 12), "weekdays": (4, 0, 6)}
    enabled = schedules.where("enabled")
    # One small file is one task: dealt out anew, every core makes rows.
    same = enabled.select("schedule_id", "cron", "timezone").repartition("schedule_id")
    parsed = enabled.select("cron", "timezone").distinct().withColumns(
        {name: cron_values(F.get(parts, F.lit(i)), low, high) for name, (i, low, high) in fields.items()}
    )
    first, last = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    # Whole quarter hours around the window; minutes outside it are dropped at the end.
    floor = F.date_trunc("HOUR", first) + F.make_dt_interval(mins=F.minute(first) - F.minute(first) % 15)
    slots = F.when(floor < last, F.sequence(floor.cast("timestamp_ntz"), last, F.expr("interval 15 minutes")))
    quarter = parsed.withColumn("slot", F.explode(slots))
    quarter = quarter.withColumn("local", F.convert_timezone(F.lit("UTC"), F.col("timezone"), F.col("slot")))
    due = quarter.where(
        F.array_contains("hours", F.hour("local"))
        & F.array_contains("days", F.dayofmonth("local"))
        & F.array_contains("months", F.month("local"))
        & F.array_contains("weekdays", F.dayofweek("local") - 1)
    )
    begin = F.minute("local")
    minutes = F.filter(F.col("minutes"), lambda m: (m >= begin) & (m < begin + 15))
    exact = due.withColumn("minute", F.explode(minutes))
    planned = exact.select(
        "cron", "timezone", (F.col("slot") + F.make_dt_interval(mins=F.col("minute") - F.minute("local"))).alias("planned_at")
    )
    inside = planned.where((F.col("planned_at") >= first) & (F.col("planned_at") < last))
    return same.join(inside, ["cron", "timezone"]).select("schedule_id", "planned_at")


def batch_targets(workflows: DataFrame, sources: DataFrame) -> DataFrame:
    """One run per enabled public source of the workflow's project."""
    open_sources = sources.where(F.col("enabled") & (F.col("access") == "PUBLIC"))
    return workflows.join(open_sources, "project_id").select("workflow_id", "source_id", "project_id")


def redact_text(value: Column, secrets: Sequence[str]) -> Column:
    """Known secret values of three or more characters, longest first."""
    ordered = sorted({s for s in secrets if len(s) >= 3}, key=lambda s: (-len(s), s))
    return reduce(lambda text, s: F.replace(text, F.lit(s), F.lit(REDACTED)), ordered, value)


def _redact(value: Column, kind: T.DataType, secrets: Sequence[str]) -> Column:
    if isinstance(kind, T.StringType):
        return redact_text(value, secrets)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _redact(v, kind.elementType, secrets))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):

        def masked(key: Column, item: Column) -> Column:
            clean = _redact(item, kind.valueType, secrets)
            if isinstance(kind.valueType, T.StringType):
                return F.when(F.lower(key).isin(*SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(clean)
            return F.when(~F.lower(key).isin(*SENSITIVE_KEYS), clean)

        return F.transform_values(value, masked)
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(REDACTED) if f.name.lower() in SENSITIVE_KEYS else _redact(value[f.name], f.dataType, secrets)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_frame(df: DataFrame, secrets: Sequence[str]) -> DataFrame:
    """Mask secret values at any depth and every sensitive field name."""
    return df.select(
        *[
            (F.lit(REDACTED) if f.name.lower() in SENSITIVE_KEYS else _redact(F.col(f"`{f.name}`"), f.dataType, secrets)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def redact_json_text(value: Column, secrets: Sequence[str]) -> Column:
    """Scalar values of sensitive keys in JSON text, then known secrets."""
    keys = "|".join(SENSITIVE_KEYS)
    scalar = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)'
    masked = F.regexp_replace(value, f'(?i)("(?:{keys})"\\s*:\\s*){scalar}', f'$1"{REDACTED}"')
    return let(masked, lambda text: redact_text(text, secrets))


def fetch_rollup(fetches: DataFrame, retry_statuses: Sequence[int] = (429, 500, 502, 503, 504), base_delay: float = 0.5) -> DataFrame:
    """``fetches(url, domain, attempts ARRAY<STRUCT<status, error>>)`` per domain and status.

    Each attempt's backoff is ``base * 2^n``; the last attempt decides success.
    """
    last = F.size("attempts") - 1
    flat = fetches.select("url", "domain", last.alias("last"), F.posexplode("attempts").alias("n", "attempt"))
    status = F.col("attempt.status")
    retried = (F.col("n") < F.col("last")) & (status.isin(*retry_statuses) | F.col("attempt.error").isNotNull())
    return flat.groupBy("domain", status.alias("status")).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(retried).alias("retries"),
        F.count_if((F.col("n") == F.col("last")) & status.between(200, 299)).alias("succeeded"),
        F.sum(F.when(retried, F.lit(base_delay) * F.pow(F.lit(2.0), F.col("n"))).otherwise(0.0)).alias("backoff_seconds"),
    )


def changed_only(feed: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Status feed rows whose payload differs from the one before for the same key."""
    marked = previous_value(feed, keys, order, digest, "__previous")
    fresh = ~F.col("__seen") | ~F.col("__previous").eqNullSafe(F.col(digest))
    return marked.where(fresh).drop("__previous", "__seen")
