"""Inputs the given tables lack, derived from them with SQL both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import dataset
from gleaner.plans.ranking import top_per_key
from queries.registry import Tables, plain

# Offer-like strings: every order gives one row.
RAW_STRINGS = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 8
    WHEN 0 THEN concat(o_orderkey % 36 + 1, ' мес')
    WHEN 1 THEN concat('от ', o_orderkey % 36 + 1, ' дней')
    WHEN 2 THEN concat('до ', o_orderkey % 36 + 1, ' года')
    WHEN 3 THEN concat('Свыше ', o_orderkey % 36 + 1, ' мес.')
    WHEN 4 THEN concat(o_orderkey % 36 + 1, '–', o_orderkey % 36 + 31, ' дней')
    WHEN 5 THEN concat('от 3 до ', o_orderkey % 36 + 1, ' мес')
    WHEN 6 THEN 'бессрочно'
    ELSE concat(' ', o_orderkey % 36 + 1, ' лет ') END AS term_raw,
  CASE o_orderkey % 7
    WHEN 0 THEN concat(o_orderkey % 20 + 1, ',5% годовых')
    WHEN 1 THEN concat('СР + ', o_orderkey % 20 + 1, ',25 п.п.')
    WHEN 2 THEN concat('СР минус ', o_orderkey % 20 + 1, ',5')
    WHEN 3 THEN 'по соглашению сторон'
    WHEN 4 THEN 'не указана'
    WHEN 5 THEN concat('Ставка рефинансирования + ', o_orderkey % 20 + 1)
    ELSE concat(' ', o_orderkey % 20 + 1, '.75 процента') END AS rate_raw,
  CASE o_orderkey % 8
    WHEN 0 THEN 'byn' WHEN 1 THEN '$' WHEN 2 THEN '€' WHEN 3 THEN 'бел. руб.'
    WHEN 4 THEN ' RUB ' WHEN 5 THEN 'BYR' WHEN 6 THEN 'GBP' ELSE '₽' END AS currency_raw,
  CASE o_orderkey % 6
    WHEN 0 THEN concat(thousands, ' ', lpad(concat('', units), 3, '0'), ',', lpad(concat('', cents), 2, '0'), ' руб')
    WHEN 1 THEN concat(thousands, '.', lpad(concat('', units), 3, '0'), ',', lpad(concat('', cents), 2, '0'))
    WHEN 2 THEN concat('-', thousands, ',', lpad(concat('', units), 3, '0'), '.', lpad(concat('', cents), 2, '0'))
    WHEN 3 THEN concat(thousands, '.', lpad(concat('', units), 3, '0'), '.', lpad(concat('', units), 3, '0'))
    WHEN 4 THEN 'нет'
    ELSE concat('итого: ', thousands, ',', lpad(concat('', cents), 2, '0'), ' %') END AS amount_raw,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('', day)
    WHEN 1 THEN concat(o_orderkey % 27 + 1, ' марта ', o_orderkey % 30 + 1990)
    WHEN 2 THEN concat('Опубликовано ', day, 'T10:00:00')
    WHEN 3 THEN 'вчера  вечером'
    ELSE concat('  ', o_orderkey % 27 + 1, '  Мая  ', o_orderkey % 30 + 1990, ' г.') END AS date_raw,
  CASE o_orderkey % 5
    WHEN 0 THEN concat(day, 'T10:20:30+03:00')
    WHEN 1 THEN concat(day, ' 10:20:30')
    WHEN 2 THEN concat(day, 'T23:20:30Z')
    WHEN 3 THEN concat(day, 'T23:20:30.250-0500')
    ELSE 'not a date' END AS moment_raw,
  CASE o_orderkey % 4
    WHEN 0 THEN concat('  ', o_orderpriority, '   x ')
    WHEN 1 THEN concat(o_orderpriority, '\t', o_orderstatus, '\n')
    WHEN 2 THEN '' ELSE o_orderpriority END AS note
FROM (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
    CAST(floor(cents_all / 100000) AS BIGINT) AS thousands,
    CAST(floor(cents_all / 100) AS BIGINT) % 1000 AS units,
    cents_all % 100 AS cents
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents_all FROM {orders}) a
) b
"""

# Record batches: each day of events is a run, the last event per key wins.
INCOMING = """
SELECT event_id, ts, user_id, event_type, value, props, run_id, natural_key, bucket,
  concat('{{"bucket":', bucket, ',"natural_key":"', natural_key, '"}}') AS data
FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, natural_key ORDER BY ts DESC, event_id DESC) AS rn
  FROM (
    SELECT event_id, ts, user_id, event_type, value, props,
      concat('', CAST(ts AS DATE)) AS run_id,
      concat(user_id, '|', event_type) AS natural_key,
      CAST(floor(value / 10) AS BIGINT) AS bucket
    FROM {events}
  ) a
) b WHERE rn = 1
"""

# Oracle side of the state tables the library functions build below.
STATE = (
    "WITH batch AS ("
    + plain(INCOMING).replace("{{", "{").replace("}}", "}")
    + """),
incoming AS (SELECT *, sha256(data) AS data_hash FROM batch),
flagged AS (SELECT *, data_hash IS DISTINCT FROM lag(data_hash) OVER (PARTITION BY natural_key ORDER BY run_id) AS content_changed FROM incoming),
observations AS (SELECT *, sum(CAST(content_changed AS INT)) OVER (PARTITION BY natural_key ORDER BY run_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version_number,
  run_id || '|' || natural_key AS observation_id, ts AS observed_at,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts - to_hours(CAST(event_id % 5 AS INT)) END AS source_published_at,
  ts - INTERVAL 1 SECOND AS fetched_at FROM flagged),
versions AS (SELECT natural_key, version_number, run_id, data, data_hash, bucket, user_id, observed_at,
  CASE WHEN user_id % 10 = 0 OR version_number % 5 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS review_status
  FROM observations WHERE content_changed),
records AS (SELECT natural_key, version_number AS current_version, version_number AS last_version, data, data_hash, user_id, bucket,
  CASE WHEN user_id % 25 = 0 THEN 'REJECTED' ELSE 'ACTIVE' END AS status,
  CASE WHEN user_id % 10 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS review_status,
  (user_id % 100) / 100.0::DOUBLE AS confidence, observed_at AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY version_number DESC) AS rn FROM versions) WHERE rn = 1),
review_tasks AS (SELECT natural_key || '#' || version_number AS task_id, natural_key, run_id, user_id, version_number, bucket,
  CASE WHEN version_number = 1 THEN 'NEW_RECORD' ELSE 'CHANGED_RECORD' END AS reason,
  data AS new_data, data_hash AS new_hash, CASE WHEN bucket = 9 THEN 'APPROVED' ELSE 'PENDING' END AS status
  FROM versions WHERE bucket >= 5)
"""
)


def incoming(t: Tables):
    return t.sql(INCOMING).withColumn("data_hash", F.sha2("data", 256))


def observations(t: Tables):
    seen = dataset.number_versions(incoming(t))
    return seen.withColumns(
        {
            "observation_id": F.concat_ws("|", "run_id", "natural_key"),
            "observed_at": F.col("ts"),
            "source_published_at": F.when(
                F.col("event_id") % 7 != 0, F.expr("ts - make_dt_interval(0, cast(event_id % 5 as int))")
            ),
            "source_modified_at": F.lit(None).cast("timestamp_ntz"),
            "fetched_at": F.expr("ts - interval 1 second"),
        }
    )


def versions(t: Tables, seen=None):
    seen = observations(t) if seen is None else seen
    waits = (F.col("user_id") % 10 == 0) | (F.col("version_number") % 5 == 0)
    return seen.where("content_changed").select(
        "natural_key",
        "version_number",
        "run_id",
        "data",
        "data_hash",
        "bucket",
        "user_id",
        "observed_at",
        F.when(waits, "PENDING").otherwise("APPROVED").alias("review_status"),
    )


def records(t: Tables, content=None):
    content = versions(t) if content is None else content
    last = top_per_key(content, ["natural_key"], [F.col("version_number").desc()])
    return last.select(
        "natural_key",
        F.col("version_number").alias("current_version"),
        F.col("version_number").alias("last_version"),
        "data",
        "data_hash",
        "user_id",
        "bucket",
        F.when(F.col("user_id") % 25 == 0, "REJECTED").otherwise("ACTIVE").alias("status"),
        F.when(F.col("user_id") % 10 == 0, "PENDING").otherwise("APPROVED").alias("review_status"),
        ((F.col("user_id") % 100) / 100.0).cast("double").alias("confidence"),
        F.col("observed_at").alias("created_at"),
    )


def review_tasks(t: Tables, content=None):
    content = versions(t) if content is None else content
    return content.where("bucket >= 5").select(
        F.concat_ws("#", "natural_key", "version_number").alias("task_id"),
        "natural_key",
        "run_id",
        "user_id",
        "bucket",
        F.when(F.col("version_number") == 1, "NEW_RECORD").otherwise("CHANGED_RECORD").alias("reason"),
        F.col("data").alias("new_data"),
        F.col("data_hash").alias("new_hash"),
        F.when(F.col("bucket") == 9, "APPROVED").otherwise("PENDING").alias("status"),
    )


# One run per order: month is the workflow's batch, the customer its source.
RUNS = """
SELECT concat('r', o_orderkey) AS run_id, concat('w', o_custkey % 10) AS workflow_id, concat('s', o_custkey % 40) AS source_id,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'PARTIAL_SUCCESS' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL '1' HOUR AS finished_at,
  o_orderkey, o_custkey, o_totalprice, o_orderpriority
FROM {orders}
"""


def runs(t: Tables):
    return t.sql(RUNS)


def raw_strings(t: Tables):
    return t.sql(RAW_STRINGS)


RAW = "WITH raw AS (" + plain(RAW_STRINGS) + ")"


# Oracle side of the canonical address, over rows ``src(…, url)``.
CANON_STEPS = """
parts AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS place,
  regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') AS path,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM src),
pairs AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x:
   {'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' '))}),
   lambda p: NOT (lower(p.k) IN ('utm', 'gclid', 'fbclid', 'yclid', 'mc_cid', 'mc_eid') OR lower(p.k) LIKE 'utm\\_%' ESCAPE '\\'))) AS kept FROM parts),
canon AS (SELECT *, scheme || '://' || place || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda p:
   replace(replace(url_encode(p.k), '%20', '+'), '%7E', '~') || '=' || replace(replace(url_encode(p.v), '%20', '+'), '%7E', '~')), '&') ELSE '' END AS canonical FROM pairs)
"""
