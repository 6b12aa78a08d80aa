"""Keys, hashes, versioned upsert and review decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.context import merge_review_policy
from gleaner.functions.records import business_columns, content_hash
from gleaner.operators import dataset, review
from queries import derived
from queries.derived import STATE
from queries.registry import Tables, query


@query(
    "natural_key",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' THEN o_custkey || '|' || o_orderstatus
  WHEN o_orderkey % 4 = 1 THEN NULL
  ELSE concat_ws('|', CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END,
    CASE WHEN o_orderkey % 4 <> 2 THEN '/list' END, o_orderkey) END AS natural_key FROM orders
""",
)
def natural_key(t: Tables):
    key = F.col("o_orderkey")
    df = t.orders.select(
        "o_orderkey",
        F.when(key % 3 != 0, F.col("o_custkey")).alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("state"),
        F.when(~(key % 4).isin(1, 2), F.lit("/list")).alias("page_url"),
        F.when(key % 4 != 1, key).alias("row_index"),
    )
    return df.select("o_orderkey", dataset.natural_key(df, ["customer", "state"]).alias("natural_key"))


@query(
    "duplicate_keys",
    """SELECT natural_key, event_id AS row, rows_with_key FROM (SELECT event_id, concat(user_id, '|', event_type, '|', CAST(ts AS DATE)) AS natural_key,
count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS rows_with_key FROM events) WHERE rows_with_key > 1""",
)
def duplicate_keys(t: Tables):
    df = t.events.withColumn("day", F.col("ts").cast("date"))
    keyed = df.select(
        F.col("event_id").alias("_seq"), dataset.natural_key(df, ["user_id", "event_type", "day"]).alias("natural_key")
    )
    return dataset.duplicate_keys(keyed).select("natural_key", F.col("_seq").alias("row"), "rows_with_key")


@query(
    "record_hash",
    """SELECT event_id, sha256('{"event_type":"' || event_type || '","note":null,"user_id":' || user_id || '}') AS data_hash FROM events""",
)
def record_hash(t: Tables):
    df = t.events.select(
        "event_id",
        "user_id",
        "event_type",
        F.lit(None).cast("string").alias("note"),
        F.col("ts").alias("fetched_at"),
        F.col("props").alias("evidence"),
        F.lit("x").alias("_provenance"),
    )
    names = [c for c in business_columns(df) if c != "event_id"]
    return df.select("event_id", content_hash(names).alias("data_hash"))


SPLIT_DAY = "2024-01-30"  # the last day is the batch, all before it the state

# State after the first half of the runs, then one later run against it.
HALF = (
    STATE
    + f""", old AS (SELECT natural_key, arg_max(data_hash, run_id) AS old_hash, arg_max(data, run_id) AS old_data, max(version_number) AS last_version
  FROM observations WHERE run_id < '{SPLIT_DAY}' GROUP BY natural_key),
cur AS (SELECT i.natural_key, i.data_hash, i.data, i.user_id, i.bucket, i.event_id, i.ts, o.old_hash, o.old_data, o.last_version,
  CASE WHEN o.old_hash IS NULL THEN 'created' WHEN o.old_hash = i.data_hash THEN 'unchanged' ELSE 'updated' END AS action
  FROM incoming i LEFT JOIN old o USING (natural_key) WHERE i.run_id = '{SPLIT_DAY}')
"""
)


def half_state(t: Tables):
    seen = derived.observations(t).where(F.col("run_id") < SPLIT_DAY)
    return derived.records(t, derived.versions(t, seen))


def next_batch(t: Tables):
    batch = derived.incoming(t).where(F.col("run_id") == SPLIT_DAY)
    return batch.drop("run_id").withColumns(
        {
            "confidence": ((F.col("user_id") % 100) / 100.0).cast("double"),
            "requires_review": F.col("bucket") == 3,
            "fetched_at": F.col("ts"),
        }
    )


POLICY = merge_review_policy({"confidence_below": 0.3}, {"changed": False}, {"new": False, "sample_unchanged": 5})


def next_run(t: Tables):
    clock = F.lit("2024-01-31T00:00:00").cast("timestamp_ntz")
    return dataset.apply_run(next_batch(t), half_state(t), SPLIT_DAY, POLICY, clock)


@query(
    "upsert_classify",
    HALF + " SELECT natural_key, action, CASE WHEN action = 'created' THEN 1 WHEN action = 'updated' THEN last_version + 1 ELSE last_version END AS version_number FROM cur",
)
def upsert_classify(t: Tables):
    compared = dataset.compare(next_batch(t), half_state(t))
    number = (
        F.when(F.col("action") == "created", 1)
        .when(F.col("action") == "updated", F.col("last_version") + 1)
        .otherwise(F.col("current_version"))
    )
    return compared.select("natural_key", "action", number.cast("bigint").alias("version_number"))


@query(
    "upsert_counters",
    HALF
    + """ SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged,
  count(*) FILTER (action <> 'unchanged' AND ((user_id % 100) / 100.0 < 0.3 OR bucket = 3)) + least(5, count(*) FILTER (action = 'unchanged')) AS review_tasks,
  least(5, count(*) FILTER (action = 'unchanged')) AS sampled_for_review FROM cur""",
)
def upsert_counters(t: Tables):
    return next_run(t).counters


@query(
    "review_required",
    HALF
    + """, r AS (SELECT natural_key, CASE WHEN action = 'created' THEN 'NEW_RECORD' ELSE 'CHANGED_RECORD' END AS reason, old_data, data AS new_data
  FROM cur WHERE action <> 'unchanged' AND ((user_id % 100) / 100.0 < 0.3 OR bucket = 3)
 UNION ALL (SELECT natural_key, 'SAMPLED_RECORD', data, data FROM cur WHERE action = 'unchanged' ORDER BY sha256('"""
    + SPLIT_DAY
    + """|' || natural_key), natural_key LIMIT 5))
 SELECT * FROM r""",
)
def review_required(t: Tables):
    return next_run(t).review_tasks.select("natural_key", "reason", "old_data", "new_data")


@query(
    "sample_unchanged",
    HALF
    + f" SELECT natural_key FROM cur WHERE action = 'unchanged' ORDER BY sha256('{SPLIT_DAY}|' || natural_key), natural_key LIMIT 7",
)
def sample_unchanged(t: Tables):
    return dataset.sample_unchanged(dataset.compare(next_batch(t), half_state(t)), SPLIT_DAY, 7).select("natural_key")


@query(
    "version_numbers",
    STATE + " SELECT natural_key, run_id, content_changed, version_number FROM observations",
)
def version_numbers(t: Tables):
    return derived.observations(t).select("natural_key", "run_id", "content_changed", "version_number")


@query(
    "observations",
    STATE
    + " SELECT observation_id, natural_key, run_id, version_number, content_changed, CAST(source_published_at AS VARCHAR) AS source_published_at, CAST(fetched_at AS VARCHAR) AS fetched_at FROM observations",
)
def observations(t: Tables):
    return derived.observations(t).select(
        "observation_id",
        "natural_key",
        "run_id",
        "version_number",
        "content_changed",
        F.col("source_published_at").cast("string"),
        F.col("fetched_at").cast("string"),
    )


@query(
    "pending_fold",
    STATE.replace("WITH batch", "WITH RECURSIVE batch", 1)
    + """, o AS (SELECT *, event_id % 3 = 0 AS review, row_number() OVER (PARTITION BY natural_key ORDER BY run_id) AS n FROM incoming),
fold AS (
  SELECT natural_key, n, run_id, CAST(1 AS BIGINT) AS version, true AS changed, data_hash AS cur, CAST(1 AS BIGINT) AS curv, CAST(1 AS BIGINT) AS top FROM o WHERE n = 1
  UNION ALL
  SELECT o.natural_key, o.n, o.run_id, CASE WHEN o.data_hash = f.cur THEN f.curv ELSE f.top + 1 END, o.data_hash <> f.cur,
    CASE WHEN o.data_hash <> f.cur AND NOT o.review THEN o.data_hash ELSE f.cur END,
    CASE WHEN o.data_hash <> f.cur AND NOT o.review THEN f.top + 1 ELSE f.curv END,
    CASE WHEN o.data_hash <> f.cur THEN f.top + 1 ELSE f.top END
  FROM fold f JOIN o ON o.natural_key = f.natural_key AND o.n = f.n + 1)
SELECT natural_key, run_id, version AS version_number, changed AS content_changed FROM fold""",
)
def pending_fold(t: Tables):
    return dataset.number_versions(derived.incoming(t), review=F.col("event_id") % 3 == 0).select(
        "natural_key", "run_id", "version_number", "content_changed"
    )


@query(
    "field_diff",
    STATE
    + """, p AS (SELECT natural_key, version_number, bucket, event_type, user_id, lag(bucket) OVER w AS ob, lag(event_type) OVER w AS oe
  FROM observations WHERE content_changed WINDOW w AS (PARTITION BY natural_key ORDER BY version_number))
SELECT natural_key, version_number, 'bucket' AS field, CAST(ob AS VARCHAR) AS old_value, CAST(bucket AS VARCHAR) AS new_value FROM p WHERE bucket IS DISTINCT FROM ob
UNION ALL SELECT natural_key, version_number, 'event_type', oe, event_type FROM p WHERE event_type IS DISTINCT FROM oe""",
)
def field_diff(t: Tables):
    from pyspark.sql import Window

    body = F.struct("bucket", "event_type")
    w = Window.partitionBy("natural_key").orderBy("version_number")
    pairs = derived.observations(t).where("content_changed").withColumns({"new": body}).withColumn("old", F.lag("new").over(w))
    diff = pairs.select(
        "natural_key", "version_number", F.explode(dataset.field_diff(pairs, ["bucket", "event_type"])).alias("field", "change")
    )
    return diff.select(
        "natural_key", "version_number", "field", F.col("change.old").alias("old_value"), F.col("change.new").alias("new_value")
    )


def decisions(tasks):
    """A decision for two of three tasks, derived from the row itself."""
    pick = F.col("user_id") % 4
    return tasks.where(pick != 3).select(
        "task_id",
        F.when(pick == 0, "APPROVED").when(pick == 1, "REJECTED").otherwise("CORRECTED").alias("decision"),
        F.when(pick == 2, F.concat(F.lit("fixed "), "natural_key")).alias("corrected_data"),
        F.when(pick == 2, F.sha2(F.concat(F.lit("fixed "), "natural_key"), 256)).alias("corrected_hash"),
        F.col("run_id").alias("decided_seq"),
    )


DECIDED = (
    STATE
    + """, decided AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'CORRECTED' END AS decision FROM review_tasks
  WHERE user_id % 4 <> 3 AND status = 'PENDING'),
best AS (SELECT natural_key, max(version_number) AS v FROM decided WHERE decision IN ('APPROVED', 'CORRECTED') GROUP BY natural_key),
hid AS (SELECT natural_key FROM decided WHERE decision = 'REJECTED' AND version_number = 1)
"""
)


def decided(t: Tables):
    content = derived.versions(t)
    tasks = derived.review_tasks(t, content)
    return review.apply_decisions(derived.records(t, content), content, tasks, decisions(tasks))


@query(
    "review_apply",
    DECIDED
    + """ SELECT r.natural_key, coalesce(b.v, r.current_version) AS current_version,
  CASE WHEN b.v IS NULL THEN r.data WHEN r.user_id % 4 = 2 THEN 'fixed ' || r.natural_key
    ELSE (SELECT data FROM versions x WHERE x.natural_key = r.natural_key AND x.version_number = b.v) END AS data,
  CASE WHEN b.v IS NOT NULL THEN CASE r.user_id % 4 WHEN 0 THEN 'APPROVED' ELSE 'CORRECTED' END
    WHEN h.natural_key IS NOT NULL AND r.review_status = 'PENDING' THEN 'REJECTED' ELSE r.review_status END AS review_status,
  CASE WHEN h.natural_key IS NOT NULL AND r.review_status = 'PENDING' THEN 'REJECTED' ELSE r.status END AS status
FROM records r LEFT JOIN best b USING (natural_key) LEFT JOIN hid h USING (natural_key)""",
)
def review_apply(t: Tables):
    return decided(t).records.select("natural_key", "current_version", "data", "review_status", "status")


@query(
    "review_reject",
    DECIDED
    + """ SELECT v.natural_key, v.version_number, CASE WHEN d.decision = 'CORRECTED' THEN 'fixed ' || v.natural_key ELSE v.data END AS data,
  coalesce(d.decision, v.review_status) AS review_status
FROM versions v LEFT JOIN decided d ON d.natural_key = v.natural_key AND d.version_number = v.version_number""",
)
def review_reject(t: Tables):
    return decided(t).versions.select("natural_key", "version_number", "data", "review_status")


@query(
    "review_conflicts",
    STATE
    + " SELECT task_id, status, CASE user_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'CORRECTED' END AS decision FROM review_tasks WHERE user_id % 4 <> 3 AND status <> 'PENDING'",
)
def review_conflicts(t: Tables):
    return decided(t).conflicts


@query(
    "accept_baseline",
    STATE
    + """, hit AS (SELECT natural_key FROM records WHERE status = 'ACTIVE' AND review_status = 'PENDING' AND current_version = 1)
SELECT 'record' AS kind, natural_key AS id, CASE WHEN natural_key IN (SELECT natural_key FROM hit) THEN 'APPROVED' ELSE review_status END AS state FROM records
UNION ALL SELECT 'version', natural_key || '#' || version_number, CASE WHEN natural_key IN (SELECT natural_key FROM hit) AND version_number = 1 THEN 'APPROVED' ELSE review_status END FROM versions
UNION ALL SELECT 'task', task_id, CASE WHEN natural_key IN (SELECT natural_key FROM hit) AND reason = 'NEW_RECORD' AND status = 'PENDING' THEN 'APPROVED' ELSE status END FROM review_tasks""",
)
def accept_baseline(t: Tables):
    content = derived.versions(t)
    out = review.accept_baseline(derived.records(t, content), content, derived.review_tasks(t, content))
    return (
        out.records.select(F.lit("record").alias("kind"), F.col("natural_key").alias("id"), F.col("review_status").alias("state"))
        .unionByName(
            out.versions.select(
                F.lit("version").alias("kind"),
                F.concat_ws("#", "natural_key", "version_number").alias("id"),
                F.col("review_status").alias("state"),
            )
        )
        .unionByName(out.tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("status").alias("state")))
    )
