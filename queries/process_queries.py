"""Row operations, normalizers, formulas, dedupe and collection operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.context import RunContext
from gleaner.functions import dates, numbers, text
from gleaner.functions.formula import float_divide, formula, signed_modulo
from gleaner.functions.records import short_identity
from gleaner.operators import collection, dedupe, rules
from gleaner.operators.process import apply_operations, map_fields, merge_fields
from queries.derived import RAW, raw_strings
from queries.registry import Tables, query

CTX = RunContext(
    "run-1", "1998-06-15T21:30:00", {"id": "src-7", "name": "Orders feed"}, {"market": "retail"}
)

# DuckDB side: white space class and cleaning, spelled out.
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def clean(column):
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


def strip(column):
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "normalize_number",
    RAW
    + r"""
, c AS (SELECT k, amount_raw, replace(replace(replace(replace(replace(lower(amount_raw), chr(160), ' '),
    'процента', ''), 'процентов', ''), 'годовых', ''), '%', '') AS s FROM raw)
, m AS (SELECT k, amount_raw, replace(regexp_extract(s, '[-+]?[0-9]+(?:[\s.,][0-9]+)*'), ' ', '') AS n FROM c)
, p AS (SELECT k, amount_raw, TRY_CAST(CASE
    WHEN n LIKE '%,%' AND n LIKE '%.%' AND length(n) - instr(reverse(n), ',') > length(n) - instr(reverse(n), '.')
      THEN replace(replace(n, '.', ''), ',', '.')
    WHEN n LIKE '%,%' AND n LIKE '%.%' THEN replace(n, ',', '')
    ELSE replace(n, ',', '.') END AS DECIMAL(38,10)) AS d FROM m)
SELECT k, CAST(d AS DOUBLE) AS amount, TRY_CAST(trunc(d) AS BIGINT) AS whole,
  CASE WHEN regexp_matches(amount_raw, '[0-9]') AND d IS NULL THEN 'NUMBER_MALFORMED' END AS error FROM p
""",
)
def normalize_number(t: Tables):
    raw = F.col("amount_raw")
    return raw_strings(t).select(
        "k",
        numbers.parse_double(raw).alias("amount"),
        numbers.parse_integer(raw).alias("whole"),
        numbers.number_error(raw).alias("error"),
    )


@query(
    "normalize_term",
    RAW
    + r"""
, c AS (SELECT k, term_raw, replace(replace(lower(trim(term_raw)), '–', '-'), '—', '-') AS s FROM raw)
, n AS (SELECT k, term_raw, s, list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS nums,
   CASE WHEN s LIKE '%год%' OR s LIKE '%лет%' THEN 365 WHEN s LIKE '%мес%' THEN 30 ELSE 1 END AS u FROM c)
SELECT k, term_raw AS term_original,
  CAST(CASE WHEN len(nums) = 0 THEN NULL WHEN s LIKE '%до %' THEN 0 ELSE nums[1] * u END AS BIGINT) AS term_min_days,
  CAST(CASE WHEN len(nums) = 0 THEN NULL WHEN s LIKE '%до %' THEN nums[1] * u
    WHEN s LIKE '%свыше%' OR s LIKE '%от %' THEN NULL
    WHEN len(nums) >= 2 THEN nums[2] * u ELSE nums[1] * u END AS BIGINT) AS term_max_days
FROM n
""",
)
def normalize_term(t: Tables):
    return apply_operations(
        raw_strings(t).select("k", "term_raw"), [{"type": "term", "field": "term_raw"}]
    ).drop("term_raw")


@query(
    "normalize_currency",
    RAW
    + """
SELECT k, CASE k % 8 WHEN 0 THEN 'BYN' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'BYN'
  WHEN 4 THEN 'RUB' WHEN 5 THEN 'BYN' WHEN 6 THEN NULL ELSE 'RUB' END AS currency FROM raw
""",
)
def normalize_currency(t: Tables):
    return raw_strings(t).select("k", numbers.parse_currency(F.col("currency_raw")).alias("currency"))


@query(
    "parse_rate",
    RAW
    + """
SELECT k,
  CASE k % 7 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'BENCHMARK_SPREAD' WHEN 2 THEN 'BENCHMARK_SPREAD'
    WHEN 3 THEN 'INDIVIDUAL' WHEN 4 THEN 'NOT_PUBLISHED' WHEN 5 THEN 'BENCHMARK_SPREAD' ELSE 'FIXED' END AS rate_type,
  CASE k % 7 WHEN 0 THEN k % 20 + 1.5 WHEN 6 THEN k % 20 + 1.75 END::DOUBLE AS rate_value,
  CASE WHEN k % 7 NOT IN (0, 6) THEN trim(rate_raw) END AS rate_formula,
  CASE k % 7 WHEN 1 THEN k % 20 + 1.25 WHEN 2 THEN -(k % 20 + 1.5) WHEN 5 THEN k % 20 + 1 END::DOUBLE AS spread_pp
FROM raw
""",
)
def parse_rate(t: Tables):
    return apply_operations(
        raw_strings(t).select("k", "rate_raw"), [{"type": "rate", "field": "rate_raw"}]
    ).drop("rate_raw")


@query(
    "publication_date",
    RAW
    + """
SELECT k, CASE k % 5
  WHEN 0 THEN date_raw
  WHEN 1 THEN concat(k % 30 + 1990, '-03-', lpad(CAST(k % 27 + 1 AS VARCHAR), 2, '0'))
  WHEN 2 THEN substr(date_raw, 14)
  WHEN 3 THEN 'вчера вечером'
  ELSE concat(k % 30 + 1990, '-05-', lpad(CAST(k % 27 + 1 AS VARCHAR), 2, '0')) END AS published
FROM raw
""",
)
def publication_date(t: Tables):
    return raw_strings(t).select("k", dates.publication_date(F.col("date_raw")).alias("published"))


@query(
    "source_datetime",
    RAW
    + """
, d AS (SELECT k, CAST(left(moment_raw, 10) AS TIMESTAMP) AS day FROM raw WHERE k % 5 <> 4
        UNION ALL SELECT k, NULL FROM raw WHERE k % 5 = 4)
SELECT k, CASE k % 5
  WHEN 0 THEN strftime(day + INTERVAL '7 hours 20 minutes 30 seconds', '%Y-%m-%dT%H:%M:%SZ')
  WHEN 1 THEN strftime((day + INTERVAL '10 hours 20 minutes 30 seconds')::TIMESTAMP AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')
  WHEN 2 THEN strftime(day + INTERVAL '23 hours 20 minutes 30 seconds', '%Y-%m-%dT%H:%M:%SZ')
  WHEN 3 THEN strftime(day + INTERVAL '28 hours 20 minutes 30 seconds', '%Y-%m-%dT%H:%M:%S') || '.250000Z'
  END AS source_published_at FROM d
""",
)
def source_datetime(t: Tables):
    return raw_strings(t).select(
        "k", dates.source_datetime(F.col("moment_raw"), "Europe/Berlin").alias("source_published_at")
    )


@query(
    "aware_ts",
    RAW
    + """
SELECT k, CASE k % 5
  WHEN 0 THEN strftime(CAST(left(moment_raw, 10) AS TIMESTAMP) + INTERVAL '7 hours 20 minutes 30 seconds', '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(CAST(left(moment_raw, 10) AS TIMESTAMP) + INTERVAL '23 hours 20 minutes 30 seconds', '%Y-%m-%d %H:%M:%S')
  WHEN 3 THEN strftime(CAST(left(moment_raw, 10) AS TIMESTAMP) + INTERVAL '28 hours 20 minutes 30 seconds', '%Y-%m-%d %H:%M:%S')
  END AS fetched_at FROM raw
""",
)
def aware_ts(t: Tables):
    return raw_strings(t).select(
        "k", F.date_format(dates.aware_timestamp(F.col("moment_raw")), "yyyy-MM-dd HH:mm:ss").alias("fetched_at")
    )


@query(
    "normalize_text",
    RAW + " SELECT k, " + strip("note") + " AS trimmed, " + clean("note") + " AS spaced FROM raw",
)
def normalize_text(t: Tables):
    return apply_operations(
        raw_strings(t).select("k", F.col("note").alias("trimmed"), F.col("note").alias("spaced")),
        [{"type": "trim", "field": "trimmed"}, {"type": "normalize_spaces", "field": "spaced"}],
    )


@query(
    "regex_extract",
    """
SELECT doc_id,
  CASE WHEN regexp_matches(text, '(?i)\\bTHE ([a-z]+)') THEN regexp_extract(text, '(?i)\\bTHE ([a-z]+)', 1) ELSE 'none' END AS after_the,
  CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN regexp_extract(text, '[0-9]{3,}') END AS digits
FROM documents
""",
)
def regex_extract(t: Tables):
    df = t.documents.select("doc_id", F.col("text").alias("after_the"), F.col("text").alias("digits"))
    return apply_operations(
        df,
        [
            {"type": "regex", "field": "after_the", "pattern": r"\bTHE ([a-z]+)", "group": 1, "flags": "i", "default": "none"},
            {"type": "regex", "field": "digits", "pattern": "[0-9]{3,}"},
        ],
    )


@query(
    "clean_text",
    "SELECT doc_id, "
    + clean("text")
    + " AS inline_text, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: "
    + clean("x")
    + "), lambda x: x <> ''), chr(10) || chr(10)) AS article_text FROM documents",
)
def clean_text(t: Tables):
    return t.documents.select(
        "doc_id",
        text.clean_inline(F.col("text")).alias("inline_text"),
        text.clean_article(F.col("text")).alias("article_text"),
    )


@query(
    "coalesce_fields",
    RAW + """ SELECT k, CASE WHEN note <> '' THEN note WHEN k % 3 = 0 THEN NULL ELSE 'fallback' END AS chosen
FROM raw WHERE k % 3 <> 0 UNION ALL
SELECT k, CASE WHEN note <> '' THEN note ELSE currency_raw END FROM raw WHERE k % 3 = 0""",
)
def coalesce_fields(t: Tables):
    df = raw_strings(t).select("k", "note", F.when(F.col("k") % 3 == 0, F.col("currency_raw")).alias("other"))
    return apply_operations(
        df, [{"type": "coalesce", "fields": ["note", "missing", "other"], "to": "chosen", "default": "fallback"}]
    ).select("k", "chosen")


@query(
    "concat_fields",
    "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, '/', o_orderpriority, '/') AS label, "
    "concat('order ', o_orderkey, ' [', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ']') AS rendered FROM orders",
)
def concat_fields(t: Tables):
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), "o_orderpriority"
    )
    df = apply_operations(
        df, [{"type": "concat", "field": "label", "fields": ["status", "o_orderpriority", "nothing"], "separator": "/"}]
    )
    rendered = text.render_template(
        "order {{ o_orderkey }} [{{input.status}}]", {"o_orderkey": F.col("o_orderkey"), "status": F.col("status")}
    )
    return df.select("o_orderkey", "label", rendered.alias("rendered"))


@query(
    "value_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, "
    "regexp_extract(o_orderpriority, '^[^-]*') AS rank, replace(o_orderpriority, '-', ': ') AS priority FROM orders",
)
def value_map(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderpriority").alias("parts"),
    )
    df = apply_operations(
        df,
        [
            {"type": "map", "field": "status", "mapping": {"F": "finished", "O": "open"}},
            {"type": "split", "field": "parts", "separator": "-"},
            {"type": "copy", "source": "parts[0]", "to": "rank"},
            {"type": "replace", "field": "priority", "search": "-", "replacement": ": "},
        ],
    )
    return df.select("o_orderkey", "status", "rank", "priority")


@query(
    "add_context",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'src-0' ELSE 'src-7' END AS source_id, 'Orders feed' AS source_name, "
    "'1998-06-15T21:30:00' AS fetched_at, concat('/o/', o_orderkey) AS page_url, 'retail' AS market, 'fixed' AS kind FROM orders",
)
def add_context(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "src-0").otherwise("").alias("source_id"),
        F.concat(F.lit("/o/"), F.col("o_orderkey")).alias("url"),
    )
    ops = [
        {"type": "add_context", "fields": ["source_id", "source_name", "fetched_at", "page_url", "market"]},
        {"type": "constant", "field": "kind", "value": "fixed"},
        {"type": "rename", "field": "url", "to": "link"},
    ]
    return apply_operations(df, ops, CTX).drop("link")


SELECTION = {
    "fields": ["text"],
    "rules": [
        {"id": "r-drop", "action": "exclude", "reason": "advert", "when": {"anyPatterns": ["http", "click here"], "nonePatterns": ["the"]}},
        {"id": "r-keep", "action": "include", "when": {"anyPatterns": ["THE ", "los "], "allPatterns": ["an"]}},
        {"id": "r-regex", "action": "include", "reason": "long number", "when": {"regex": True, "anyPatterns": ["[0-9]{4}"]}},
    ],
}


@query(
    "select_by_rules",
    """
WITH d AS (SELECT doc_id, lower(text) AS s, text FROM documents),
h AS (SELECT doc_id,
  (contains(s, 'http') OR contains(s, 'click here')) AND NOT contains(s, 'the') AS a,
  (contains(s, 'the ') OR contains(s, 'los ')) AND contains(s, 'an') AS b,
  regexp_matches(text, '[0-9]{4}') AS c, s FROM d)
SELECT doc_id,
  CASE WHEN a THEN 'EXCLUDE' WHEN b THEN 'INCLUDE' WHEN c THEN 'INCLUDE' ELSE 'AMBIGUOUS' END AS candidate_status,
  CASE WHEN a THEN 'r-drop' WHEN b THEN 'r-keep' WHEN c THEN 'r-regex' ELSE 'unclassified-v1' END AS selection_rule_id,
  CASE WHEN a THEN 'advert' WHEN b THEN 'r-keep' WHEN c THEN 'long number' ELSE 'no deterministic rule matched' END AS selection_reason,
  CASE WHEN a THEN concat_ws('|', CASE WHEN contains(s, 'http') THEN 'http' END, CASE WHEN contains(s, 'click here') THEN 'click here' END)
       WHEN b THEN concat_ws('|', CASE WHEN contains(s, 'the ') THEN 'THE ' END, CASE WHEN contains(s, 'los ') THEN 'los ' END, 'an')
       WHEN c THEN '[0-9]{4}' ELSE '' END AS matched_terms, 'text' AS evidence_fields
FROM h
""",
)
def select_by_rules(t: Tables):
    return rules.select_by_rules(t.documents.select("doc_id", "text"), SELECTION).select(
        "doc_id",
        "candidate_status",
        "selection_rule_id",
        "selection_reason",
        F.array_join("selection_evidence.matched_terms", "|").alias("matched_terms"),
        F.array_join("selection_evidence.fields", "|").alias("evidence_fields"),
    )


@query(
    "classify_access",
    """
SELECT doc_id,
  CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'PAYWALLED'
       WHEN lang = 'de' THEN 'ACCESS_LIMITED' ELSE 'PUBLIC' END AS access_status,
  CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR lang = 'de' THEN NULL ELSE sha256(text) END AS body_sha
FROM documents
""",
)
def classify_access(t: Tables):
    out = rules.classify_access(
        t.documents.select("doc_id", "text", "lang"),
        {
            "fields": ["text"],
            "rules": [
                {"status": "paywalled", "when": {"anyPatterns": ["license", "copyright"]}},
                {"status": "metered", "when": {"fields": ["lang"], "regex": True, "anyPatterns": ["^DE$"]}},
            ],
            "redactFields": ["text"],
        },
    )
    return out.select("doc_id", "access_status", F.sha2("text", 256).alias("body_sha"))


@query(
    "filter_decisions",
    """
WITH d AS (SELECT doc_id, CASE
  WHEN lang = 'es' THEN 'no spanish'
  WHEN text = '' THEN 'text:empty'
  WHEN regexp_matches(text, '(?i)lorem|http') THEN 'text:regex'
  WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'source:in:not_matched' END AS reason FROM documents)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'INCLUDED' ELSE 'EXCLUDED' END AS action,
  coalesce(reason, 'PASSED_DETERMINISTIC_RULES') AS reason FROM d
""",
)
def filter_decisions(t: Tables):
    out = rules.decide_filters(
        t.documents,
        [
            {"field": "lang", "operator": "equals", "value": "es", "reason": "no spanish"},
            {"field": "text", "operator": "empty"},
            {"field": "text", "operator": "regex", "value": "lorem|http"},
            {"field": "source", "operator": "in", "value": ["src0", "src1", "src2"], "action": "include_only"},
        ],
    )
    return out.select("doc_id", F.col("_action").alias("action"), F.col("_reason").alias("reason"))


@query(
    "formula_arith",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS net,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS ratio,
  CAST(((l_partkey - 50) % 7 + 7) % 7 AS BIGINT) AS remainder, pow(CAST(l_linenumber AS DOUBLE), 2) AS square,
  CASE WHEN 1 < l_linenumber AND l_linenumber < 4 THEN 'mid' ELSE 'edge' END AS band
FROM lineitem
""",
)
def formula_arith(t: Tables):
    df = t.lineitem
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(formula(df, "l_extendedprice * (1 - l_discount) * (1 + l_tax)"), 6).alias("net"),
        F.round(float_divide(F.col("l_quantity"), F.col("l_discount")), 6).alias("ratio"),
        signed_modulo(F.col("l_partkey") - 50, F.lit(7)).cast("bigint").alias("remainder"),
        formula(df, "power(l_linenumber, 2)").alias("square"),
        formula(df, "case when 1 < l_linenumber and l_linenumber < 4 then 'mid' else 'edge' end").alias("band"),
    )


@query(
    "formula_dates",
    """
WITH e AS (SELECT event_id, ts, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS l FROM events)
SELECT event_id, strftime(l, '%Y-%m-%d') || 'T00:00:00+09:00' AS day_start,
  strftime(l, '%Y-%m-%d') || 'T23:59:59.999999+09:00' AS day_end,
  strftime(CAST(ts AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d') AS plus_ten,
  strftime(date_trunc('second', ts) + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S') AS plus_two,
  strftime(ts, '%d.%m.%Y %H:%M') AS shown, strftime(ts, '%Y-%m-%d') AS parsed,
  '1998-06-16' AS today, '1998-06-15' AS yesterday, '1998-06-16T06:30:00+09:00' AS now
FROM e
""",
)
def formula_dates(t: Tables):
    ts = F.col("ts").cast("timestamp_ntz")
    clock = CTX.clock_column()
    return t.events.select(
        "event_id",
        dates.start_of_day(ts, "Asia/Tokyo").alias("day_start"),
        dates.end_of_day(ts, "Asia/Tokyo").alias("day_end"),
        dates.add_days(dates.format_date(ts, "YYYY-MM-DD"), 10).alias("plus_ten"),
        dates.add_days(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 2).alias("plus_two"),
        dates.format_date(ts, "DD.MM.YYYY HH:mm").alias("shown"),
        dates.parse_date(dates.format_date(ts, "DD/MM/YYYY"), "DD/MM/YYYY").alias("parsed"),
        dates.today(clock, "Asia/Tokyo").alias("today"),
        dates.yesterday(clock, "Asia/Tokyo").alias("yesterday"),
        dates.now_text(clock, "Asia/Tokyo").alias("now"),
    )


@query(
    "dedupe_first",
    "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END, "
    "event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def dedupe_first(t: Tables):
    df = t.events.select(
        F.col("event_id").alias("_seq"),
        "user_id",
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("key_user"),
        "event_type",
    )
    return dedupe.keep_first(df, ["key_user", "event_type"]).select(
        F.col("_seq").alias("event_id"), "user_id", "event_type"
    )


@query(
    "dedupe_decisions",
    """
SELECT doc_id, CASE WHEN rn = 1 THEN 'KEPT' ELSE 'DEDUPLICATED' END AS action,
  CASE WHEN rn > 1 THEN 'NATURAL_IDENTITY' END AS reason,
  left(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","text_sha":"' || sha256(text) || '"}'), 16) AS record
FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) AS rn FROM documents)
""",
)
def dedupe_decisions(t: Tables):
    # The digest stands for the text in the key, so long texts are not shuffled.
    df = t.documents.select("doc_id", F.col("doc_id").alias("_seq"), "lang", F.sha2("text", 256).alias("text_sha"))
    out = dedupe.dedupe_decisions(df, ["text_sha", "lang"])
    return out.select(
        "doc_id",
        F.when(F.col("_kept"), "KEPT").otherwise("DEDUPLICATED").alias("action"),
        F.when(~F.col("_kept"), F.lit("NATURAL_IDENTITY")).alias("reason"),
        short_identity(["doc_id", "lang", "text_sha"]).alias("record"),
    )


DOC_LINES_ORACLE = """
WITH lines AS (SELECT doc_id, item, item + 1 AS line_no, CAST(length(line) AS BIGINT) AS size, (doc_id * 31 + item * 7) % 100 AS code,
  CAST(length(line) % 50 AS DOUBLE) AS amount, length(line) * 1.5::DOUBLE AS price, ['A', 'N', 'R'][item % 3 + 1] AS flag
  FROM (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS item, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
"""


def doc_lines(t: Tables):
    """Documents with their lines as nested rows; each list comes from one input row."""
    size = lambda x: F.char_length(x).cast("bigint")
    line = lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("line_no"),
        size(x).alias("size"),
        ((F.col("doc_id") * 31 + i * 7) % 100).alias("code"),
        (size(x) % 50).cast("double").alias("amount"),
        (size(x) * F.lit(1.5)).alias("price"),
        F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), i % 3).alias("flag"),
    )
    return t.documents.select("doc_id", F.transform(F.split("text", "\n"), line).alias("lines"))


@query(
    "explode_items",
    DOC_LINES_ORACLE + " SELECT doc_id AS source_row, item AS source_item, size, amount FROM lines",
)
def explode_items(t: Tables):
    df = doc_lines(t).withColumn("_seq", F.col("doc_id"))
    out = collection.explode_field(df, "lines", "line")
    return out.select("_collection.source_row", "_collection.source_item", "line.size", "line.amount")


@query(
    "expand_tiers",
    DOC_LINES_ORACLE + " SELECT doc_id, item AS source_item, amount, price, line_no FROM lines",
)
def expand_tiers(t: Tables):
    df = doc_lines(t).withColumns({"_seq": F.col("doc_id"), "amount": F.lit(-1.0)})
    return collection.expand_tiers(df, "lines").select("doc_id", "_collection.source_item", "amount", "price", "line_no")


@query(
    "unpivot_matrix",
    """
SELECT p_partkey, 'name' AS dimension, p_name AS value FROM part WHERE p_name <> ''
UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
""",
)
def unpivot_matrix(t: Tables):
    df = t.part.select(
        F.col("p_partkey").alias("_seq"),
        "p_partkey",
        F.col("p_name").alias("term:name"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("").alias("term:brand"),
        F.col("p_size").alias("term:size"),
        F.col("p_type").alias("other"),
    )
    out = collection.unpivot_columns(df, ["p_partkey"], "term:*", "dimension", "value", skip_empty=True)
    return out.select("p_partkey", "dimension", "value")


@query(
    "effective_revision",
    """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS f, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 300 DAY END AS e FROM orders),
v AS (SELECT * FROM r WHERE (f IS NULL OR f <= TIMESTAMP '1996-06-15') AND (e IS NULL OR TIMESTAMP '1996-06-15' < e)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY f DESC NULLS LAST, o_orderkey) AS rn FROM v) WHERE rn = 1)
SELECT o_custkey, o_orderkey FROM b
UNION ALL SELECT o_custkey, o_orderkey FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
""",
)
def effective_revision(t: Tables):
    key = F.col("o_orderkey")
    revisions = t.orders.select(
        "o_custkey",
        "o_orderkey",
        key.alias("_seq"),
        F.when(key % 6 != 0, F.col("o_orderdate")).alias("effective_from"),
        F.when(key % 5 != 0, F.expr("o_orderdate + interval 300 days")).alias("effective_to"),
    )
    at = F.lit("1996-06-15T00:00:00").cast("timestamp_ntz")
    return collection.effective_revision(revisions, at, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query(
    "condition_split",
    "SELECT branch, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_totalprice > 200000 "
    "THEN 'true' ELSE 'false' END AS branch FROM orders) GROUP BY branch",
)
def condition_split(t: Tables):
    df = t.orders.withColumn("price", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    yes, no = rules.route(df, "price", "gt", 200000)
    both = yes.select("o_orderkey", F.lit("true").alias("branch")).unionByName(
        no.select("o_orderkey", F.lit("false").alias("branch"))
    )
    return both.groupBy("branch").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")
    )


@query(
    "mapping_required",
    """
SELECT o_orderkey AS row, 'status' AS field, 'REQUIRED' AS code FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'per_unit', 'EXPRESSION' FROM orders WHERE o_orderkey % 10 = 0
""",
)
def mapping_required(t: Tables):
    df = t.orders.select(
        F.col("o_orderkey").alias("_seq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("state"),
        "o_totalprice",
        (F.col("o_orderkey") % 10).alias("units"),
    )
    _, errors = map_fields(
        df,
        [
            {"target": "kind", "constant": "order"},
            {"target": "status", "source": "state", "required": True},
            {"target": "per_unit", "expression": "try_divide(o_totalprice, units)", "default": None},
            {"target": "note", "source": "nothing", "default": "n/a", "required": True},
        ],
    )
    return errors.select(F.col("_seq").alias("row"), "field", "code")


@query("field_names", """
SELECT DISTINCT p_name AS header, regexp_replace(regexp_replace(lower(trim(p_name)), '[^0-9a-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS field FROM part
UNION SELECT DISTINCT 'Срок, мес. (' || p_size || ')', 'срок_мес_' || p_size FROM part
""")
def field_names(t: Tables):
    headers = t.part.select(F.col("p_name").alias("header")).unionByName(
        t.part.select(F.concat(F.lit("Срок, мес. ("), F.col("p_size"), F.lit(")")).alias("header"))
    )
    return headers.distinct().select("header", text.field_name(F.col("header")).alias("field"))


@query(
    "branch_merge",
    """
WITH last AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS balance, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_custkey),
keys AS (SELECT c_custkey AS k FROM customer UNION SELECT k FROM last)
SELECT keys.k, c.c_name AS name, CASE WHEN c.c_custkey % 3 = 0 THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'b-' || c.c_custkey END ELSE c.c_mktsegment END AS segment,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'seen' END AS extra, CASE WHEN last.k IS NULL THEN c.c_acctbal ELSE last.balance END AS balance, last.state
FROM keys LEFT JOIN customer c ON c.c_custkey = keys.k LEFT JOIN last ON last.k = keys.k
""",
)
def branch_merge(t: Tables):
    key = F.col("c_custkey")
    base = t.customer.select(key.alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.lit(0).cast("bigint").alias("seq"))
    some = t.customer.where(key % 3 == 0).select(
        key.alias("k"), F.when(key % 2 == 0, F.concat(F.lit("b-"), key)).alias("segment"), F.lit("seen").alias("extra"), F.lit(0).cast("bigint").alias("seq")
    )
    orders = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("balance"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("seq"))
    return merge_fields([base, some, orders], ["k"], "seq")


@query(
    "process_provenance",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'feed' END AS source, 'process@7' AS revision FROM orders",
)
def process_provenance(t: Tables):
    from gleaner.operators.process import with_process_provenance

    known = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "feed").alias("source"))
    rows = with_process_provenance(t.orders.withColumn("_provenance", known), "process@7")
    return rows.select("o_orderkey", F.col("_provenance.source").alias("source"), F.col("_provenance.process.transform_revision").alias("revision"))


@query(
    "dedupe_text_keys",
    """SELECT min(o_orderkey) AS o_orderkey, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END, '') || '|' || o_orderpriority AS k FROM orders GROUP BY k""",
)
def dedupe_text_keys(t: Tables):
    """Extracted records: the joined text of the key fields, where null and empty are one."""
    from gleaner.operators.dedupe import keep_first_text

    status = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 8 > 0, "")
    rows = t.orders.select("o_orderkey", F.col("o_orderkey").alias("_seq"), status.alias("status"), "o_orderpriority")
    kept = keep_first_text(rows, ["status", "o_orderpriority"])
    return kept.select("o_orderkey", F.concat_ws("|", F.coalesce("status", F.lit("")), "o_orderpriority").alias("k"))


@query(
    "validity_moments",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 HOUR AS VARCHAR)
  WHEN 1 THEN CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 HOUR AS VARCHAR) END AS moment FROM orders""",
)
def validity_moments(t: Tables):
    """Texts without a zone are UTC."""
    from gleaner.functions.dates import utc_timestamp

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T10:00:00"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T10:00:00+03:00"))).otherwise("soon")
    return t.orders.select("o_orderkey", utc_timestamp(text).cast("string").alias("moment"))
