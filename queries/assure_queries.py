"""Validation, coverage, quarantine and assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import assure
from queries.registry import Tables, query


def labelled(t: Tables):
    """Documents with their labels; most documents have none, so labels are null there."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("_seq"), "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


LABELLED = "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


@query(
    "validate_required",
    LABELLED
    + """ SELECT doc_id AS row, 'quality' AS field, 'REQUIRED' AS code FROM d WHERE quality IS NULL
UNION ALL SELECT doc_id, 'missing', 'REQUIRED' FROM d""",
)
def validate_required(t: Tables):
    df = labelled(t)
    checked = assure.with_errors(df, assure.required_checks(df, ["quality", "lang", "missing"]))
    return assure.error_rows(checked).select(F.col("_seq").alias("row"), "field", "code")


@query(
    "validate_ranges",
    """SELECT o_orderkey AS row, 'o_totalprice' AS field, 'RANGE' AS code FROM orders WHERE o_totalprice < 10000 OR o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'o_custkey', 'RANGE' FROM orders WHERE o_custkey < 10""",
)
def validate_ranges(t: Tables):
    df = t.orders.withColumn("_seq", F.col("o_orderkey"))
    rules = [{"field": "o_totalprice", "min": 10000, "max": 400000}, {"field": "o_custkey", "min": 10}]
    return assure.error_rows(assure.with_errors(df, assure.range_checks(df, rules))).select(
        F.col("_seq").alias("row"), "field", "code"
    )


CUSTOMER_SCHEMA = {
    "required": ["c_name", "c_mktsegment", "c_phone"],
    "properties": {
        "c_name": {"type": "string", "pattern": "^Customer#[0-9]*[02468]$", "minLength": 5},
        "c_acctbal": {"type": "number", "minimum": 0},
        "c_mktsegment": {"enum": ["HOUSEHOLD", "MACHINERY", "BUILDING"]},
        "c_nationkey": {"type": ["integer", "null"], "maximum": 20},
        "c_custkey": {"type": "string"},
    },
}


@query(
    "validate_schema",
    """
SELECT c_custkey AS row, 'c_phone' AS field, 'SCHEMA_REQUIRED' AS code FROM customer
UNION ALL SELECT c_custkey, 'c_name', 'SCHEMA_PATTERN' FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')
UNION ALL SELECT c_custkey, 'c_acctbal', 'SCHEMA_MINIMUM' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'SCHEMA_ENUM' FROM customer WHERE c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING')
UNION ALL SELECT c_custkey, 'c_nationkey', 'SCHEMA_MAXIMUM' FROM customer WHERE c_nationkey > 20
UNION ALL SELECT c_custkey, 'c_custkey', 'SCHEMA_TYPE' FROM customer
""",
)
def validate_schema(t: Tables):
    df = t.customer.withColumn("_seq", F.col("c_custkey"))
    return assure.error_rows(assure.with_errors(df, assure.schema_checks(df, CUSTOMER_SCHEMA))).select(
        F.col("_seq").alias("row"), "field", "code"
    )


@query(
    "field_coverage",
    LABELLED
    + """ SELECT 'quality' AS field, 0.5::DOUBLE AS expected, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS actual,
  avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.5 AS passed FROM d
UNION ALL SELECT 'lang', 0.9::DOUBLE, round(avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0 END), 6)::DOUBLE, avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0 END) >= 0.9 FROM d""",
)
def field_coverage(t: Tables):
    return assure.coverage(labelled(t), {"quality": 0.5, "lang": 0.9})


@query(
    "expected_states",
    """SELECT s.state FROM (VALUES ('en'), ('de'), ('fr'), ('be'), ('ru')) s(state)
WHERE s.state NOT IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)""",
)
def expected_states(t: Tables):
    return assure.missing_states(t.documents, "lang", ["en", "de", "fr", "be", "ru"])


@query(
    "date_window_violations",
    """SELECT event_id AS row, 'published' AS field, 'DATE_WINDOW_VIOLATION' AS code FROM events
WHERE event_id % 11 = 0 OR ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-20'""",
)
def date_window_violations(t: Tables):
    df = t.events.select(
        F.col("event_id").alias("_seq"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("published")
    )
    lower, upper = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-20"))
    return assure.error_rows(assure.with_errors(df, assure.window_checks(df, "published", lower, upper))).select(
        F.col("_seq").alias("row"), "field", "code"
    )


@query(
    "quarantine_split",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice > 300000 THEN 'quarantined' ELSE 'clean' END AS side FROM orders""",
)
def quarantine_split(t: Tables):
    df = t.orders.select(
        F.col("o_orderkey").alias("_seq"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"),
        "o_totalprice",
    )
    checks = assure.required_checks(df, ["state"]) + assure.range_checks(df, [{"field": "o_totalprice", "max": 300000}])
    clean, held = assure.quarantine(assure.with_errors(df, checks))
    return clean.select("o_orderkey", F.lit("clean").alias("side")).unionByName(
        held.select("o_orderkey", F.lit("quarantined").alias("side"))
    )


@query(
    "assessment",
    """
WITH e AS (SELECT CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS a, CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS b FROM lineitem)
SELECT count(*) AS records, count(*) - sum(CASE WHEN a + b > 0 THEN 1 ELSE 0 END)::BIGINT AS records_left,
  (sum(a) + sum(b))::BIGINT AS row_errors, 'PARTIAL' AS status,
  array_to_string(list_sort(list_filter(['REQUIRED_FIELD_COVERAGE', 'SOURCE_ROLE_MISMATCH',
    CASE WHEN sum(a) > 0 THEN 'RANGE' END, CASE WHEN sum(b) > 0 THEN 'REQUIRED' END,
    CASE WHEN count(*) < 100000000 THEN 'MINIMUM_EXPECTED_RECORDS' END], lambda x: x IS NOT NULL)), '|') AS codes,
  true AS commit_allowed FROM e
""",
)
def assessment(t: Tables):
    df = t.lineitem.select(
        F.col("l_orderkey").alias("_seq"),
        "l_quantity",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
        "l_returnflag",
    )
    checks = assure.range_checks(df, [{"field": "l_quantity", "max": 45}]) + assure.required_checks(df, ["discount"])
    want = assure.Expectations(
        minimum_records=100_000_000,
        coverage={"discount": 0.99},
        role_column="l_returnflag",
        expected_role="X",
        allow_partial_commit=True,
        quarantine=True,
    )
    return assure.assess(assure.with_errors(df, checks), want)


@query(
    "postconditions",
    """
WITH a AS (SELECT count(*) AS n, avg(o_totalprice) AS p, count(DISTINCT o_custkey) AS c FROM orders)
SELECT 'enough_rows' AS name, n >= 1000 AS passed FROM a UNION ALL SELECT 'price', p > 1000000 FROM a UNION ALL SELECT 'customers', c <> 0 FROM a
""",
)
def postconditions(t: Tables):
    return assure.postconditions(
        t.orders,
        {
            "enough_rows": (F.count(F.lit(1)), "gte", 1000),
            "price": (F.avg("o_totalprice"), "gt", 1_000_000),
            "customers": (F.countDistinct("o_custkey"), "ne", 0),
        },
    )


@query(
    "postcondition_kinds",
    """
WITH a AS (SELECT count(DISTINCT lang) AS langs, max(length(text)) AS longest, min(lang) AS first, count(*) FILTER (lang = 'none') AS none FROM documents)
SELECT unnest(['langs', 'many', 'long', 'text', 'there', 'nothing', 'first', 'no_list']) AS name,
  unnest([langs >= 2, langs >= 50, longest >= 100, longest >= 10000000, true, false, true, false]) AS passed FROM a
""",
)
def postcondition_kinds(t: Tables):
    longest = F.max_by("text", F.char_length("text"))
    return assure.postconditions(
        t.documents,
        {
            "langs": (F.collect_set("lang"), "minItems", 2),
            "many": (F.collect_set("lang"), "minItems", 50),
            "long": (longest, "minLength", 100),
            "text": (longest, "minLength", 10_000_000),
            "there": (F.min("lang"), "exists", None),
            "nothing": (F.max(F.when(F.col("lang") == "none", F.col("lang"))), "exists", None),
            "first": (F.count(F.lit(1)) > 0, "equals", True),
            "no_list": (F.max("doc_id"), "minItems", 1),
        },
    )


@query(
    "ratio_checks",
    """
SELECT part, array_to_string(list_sort(list_filter([CASE WHEN n > 0 AND ok / n < 0.9 THEN 'DETAIL_COVERAGE_FAILED' END,
  CASE WHEN parsed / documents < 0.75 THEN 'DOCUMENT_PARSE_INCOMPLETE' END], lambda x: x IS NOT NULL)), '|') AS codes, n AS records
FROM (VALUES ('good', 95, 10, 8), ('few', 50, 10, 8), ('unread', 95, 10, 7), ('both', 10, 10, 1)) v(part, percent, documents, parsed),
  LATERAL (SELECT count(*) AS n, count(*) * percent // 100 AS ok FROM orders) x
""",
)
def ratio_checks(t: Tables):
    total, out = t.orders.count(), None
    checked = assure.with_errors(t.orders.select(F.col("o_orderkey").alias("_seq")), [])
    want = assure.Expectations(detail_ratio=0.9, document_ratio=0.75)
    for part, percent, documents, parsed in (("good", 95, 10, 8), ("few", 50, 10, 8), ("unread", 95, 10, 7), ("both", 10, 10, 1)):
        counters = {"discovered": total, "succeeded": total * percent // 100, "documents_discovered": documents, "documents_parsed": parsed}
        row = assure.assess(checked, want, counters).select(F.lit(part).alias("part"), "codes", "records")
        out = row if out is None else out.unionByName(row)
    return out
