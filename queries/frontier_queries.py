"""URL canonical form, frontier, link graph and crawl bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.operators import frontier
from queries import markup_queries
from queries.derived import CANON_STEPS
from queries.registry import Tables, plain, query

# Variants of every page address: tracking, case, slashes, parameter order.
URLS = """
SELECT page_id, v, CASE v
  WHEN 0 THEN url
  WHEN 1 THEN concat(upper(substr(url, 1, 8)), substr(url, 9), CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END, 'utm_medium=a&z=1&b=&a=%7Ex%20y+z&GCLID=9')
  WHEN 2 THEN concat(regexp_replace(url, '[?#].*$', ''), '//sub//', page_id, '///?q=a*b&q=A&m=%D0%B6#frag')
  ELSE concat('ftp://files.example.com/', page_id) END AS url
FROM (SELECT page_id, url, 0 AS v FROM {pages} UNION ALL SELECT page_id, url, 1 AS v FROM {pages}
  UNION ALL SELECT page_id, url, 2 AS v FROM {pages} UNION ALL SELECT page_id, url, 3 AS v FROM {pages}) x
"""
CANON = "WITH src AS (" + plain(URLS) + ")," + CANON_STEPS


def url_table(t: Tables):
    return t.sql(URLS)


@query("canonical_url", CANON + " SELECT page_id, CAST(v AS BIGINT) AS variant, canonical, left(sha256(canonical), 20) AS record_id FROM canon")
def canonical_url(t: Tables):
    value = urls.canonical_url(F.col("url"))
    return url_table(t).select("page_id", F.col("v").cast("bigint").alias("variant"), value.alias("canonical")).withColumn(
        "record_id", urls.short_id(F.col("canonical"))
    )


@query(
    "url_frontier",
    CANON
    + """, f AS (SELECT *, page_id * 4 + v AS seq, regexp_extract(canonical, '(?i)/(en|de)/([0-9]+)', 1) AS lang, regexp_extract(canonical, '(?i)/(en|de)/([0-9]+)', 2) AS num
  FROM canon WHERE scheme IN ('http', 'https') AND regexp_matches(canonical, '(?i)/(en|de)/([0-9]+)') AND (regexp_extract(place, '^[^:]*') = 'example.com' OR regexp_extract(place, '^[^:]*') LIKE '%.example.com')
    AND page_id % 9 <> 4)
SELECT seq, canonical, CASE WHEN page_id % 10 = 0 THEN 'given-' || page_id ELSE lang END AS record_id, lang, num FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY seq) AS rn FROM f) WHERE rn = 1""",
)
def url_frontier(t: Tables):
    pid = F.col("page_id")
    items = url_table(t).select(
        (pid * 4 + F.col("v")).alias("_seq"),
        F.struct(F.col("url").alias("href")).alias("link"),
        F.when(pid % 9 != 4, "Quarterly report").otherwise("other").alias("title"),
        F.when(pid % 10 == 0, F.concat(F.lit("given-"), pid)).alias("record_id"),
    )
    found = frontier.url_frontier(
        items,
        {
            "url_path": "link.href",
            "frontier_title_patterns": ["^quarterly"],
            "allowed_domains": ["example.com"],
            "url_pattern": "/(?P<lang>en|de)/(?P<num_id>[0-9]+)",
        },
        F.lit("https://example.com/"),
        F.lit("https://example.com/"),
    )
    return found.select(F.col("_seq").alias("seq"), "canonical", "record_id", "lang", F.col("num_id").alias("num"))


@query(
    "url_policy",
    CANON
    + """ SELECT page_id, CAST(v AS BIGINT) AS variant, CASE WHEN v = 3 THEN 'SCHEME' WHEN page_id % 13 = 0 THEN 'HOST' WHEN page_id % 7 = 0 THEN 'PORT'
  WHEN NOT (place = 'example.com' OR place LIKE '%.example.com') THEN 'DOMAIN' WHEN page_id % 5 = 0 THEN 'ADDRESS' WHEN page_id % 17 = 0 THEN 'UNRESOLVED' END AS violation FROM canon""",
)
def url_policy(t: Tables):
    pid = F.col("page_id")
    shaped = F.when(pid % 13 == 0, F.regexp_replace("url", "://", "://user:pw@")).when(
        pid % 7 == 0, F.regexp_replace("url", "(?i)^(https?://[^/?#]*)", "$1:8080")
    )
    private = F.array(*[F.lit(a) for a in ("10.1.2.3", "192.168.0.9", "127.0.0.1", "172.20.1.1", "169.254.0.1")])
    address = F.when(pid % 5 == 0, F.get(private, (pid % 25 / 5).cast("int"))).when(pid % 17 != 0, F.concat(F.lit("93.184.216."), pid % 256))
    table = url_table(t).withColumns({"url": F.coalesce(shaped, "url"), "address": address})
    return frontier.url_policy(table, address="address", domains=["example.com"]).select(
        "page_id", F.col("v").cast("bigint").alias("variant"), "violation"
    )


@query(
    "merge_parent_child",
    """SELECT c_custkey AS url, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS title, c_mktsegment AS segment FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def merge_parent_child(t: Tables):
    parents = t.customer.select(F.col("c_custkey").alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    children = t.orders.select(
        F.col("o_custkey").alias("url"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title")
    )
    return frontier.merge_parent_child(parents, children, "url").select("url", "o_orderkey", "title", "segment")


@query(
    "fanout_split",
    """WITH j AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT count(*) FILTER (n > 0) AS succeeded, count(*) FILTER (n = 0) AS failed, count(*) FILTER (n > 0) >= 100 AS accepted, count(*) FILTER (n > 0) > 0 AND count(*) FILTER (n = 0) > 0 AS partial FROM j""",
)
def fanout_split(t: Tables):
    details = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = t.customer.select("c_custkey").join(details, "c_custkey", "left")
    return frontier.fanout_split(joined, F.col("n") > 0, "REQUIRE_MINIMUM", 100)[2]


EDGES = "SELECT page_id AS src, page_id * 2 AS dst FROM {pages} UNION ALL SELECT page_id AS src, page_id * 2 + 1 AS dst FROM {pages} UNION ALL SELECT page_id AS src, page_id - page_id % 7 AS dst FROM {pages}"


@query(
    "link_bfs",
    "WITH RECURSIVE e AS (" + plain(EDGES) + """), valid AS (SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT page_id FROM pages)),
b(url, depth) AS (SELECT page_id, 1 FROM pages WHERE page_id IN (1, 100) UNION SELECT dst, depth + 1 FROM b JOIN valid ON src = url WHERE depth < 5)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY url""",
)
def link_bfs(t: Tables):
    known = t.pages.select(F.col("page_id").alias("dst"))
    links = t.sql(EDGES).join(known, "dst", "left_semi")
    seeds = t.pages.where(F.col("page_id").isin(1, 100)).select(F.col("page_id").alias("url"))
    return frontier.crawl_closure(seeds, links, max_depth=5).select("url", F.col("depth").cast("bigint").alias("depth"))


@query(
    "resume_set",
    """WITH failed AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48)
SELECT o_orderkey AS url, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM failed) THEN 'retry' ELSE 'completed' END AS state FROM orders""",
)
def resume_set(t: Tables):
    attempted = t.orders.select(F.col("o_orderkey").alias("url"))
    errors = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("url"))
    done, retry = frontier.resume_sets(attempted, errors)
    return done.withColumn("state", F.lit("completed")).unionByName(retry.withColumn("state", F.lit("retry")))


@query(
    "checkpoint_skip",
    """SELECT DISTINCT l_partkey AS url, 'todo' AS state FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)
UNION ALL SELECT count(*), 'checkpoint' FROM (SELECT p_partkey FROM part WHERE p_size < 25 UNION SELECT l_partkey FROM lineitem)""",
)
def checkpoint_skip(t: Tables):
    found = t.lineitem.select(F.col("l_partkey").alias("url")).distinct()
    done = t.part.where("p_size < 25").select(F.col("p_partkey").alias("url"))
    todo = frontier.not_completed(found, done)
    after = frontier.advance_checkpoint(done, todo).agg(F.count(F.lit(1)).alias("url"))
    return todo.withColumn("state", F.lit("todo")).unionByName(after.withColumn("state", F.lit("checkpoint")))


@query(
    "link_closure_full",
    """SELECT page_id AS url, CAST((page_id - 1) % 24 + 1 AS BIGINT) AS depth, FALSE AS truncated FROM pages
WHERE page_id >= 1 AND page_id - (page_id - 1) % 24 IN (SELECT page_id FROM pages)""",
)
def link_closure_full(t: Tables):
    """Chains of 24 pages, followed to their ends."""
    links = t.pages.where("page_id % 24 <> 0 AND page_id >= 1").select(F.col("page_id").alias("src"), (F.col("page_id") + 1).alias("dst"))
    links = links.join(t.pages.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    seeds = t.pages.where("page_id % 24 = 1").select(F.col("page_id").alias("url"))
    found = frontier.crawl_closure(seeds, links)
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "truncated")


@query(
    "repeated_pages",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang = 'de', sha256(text)) END AS first_seen,
  lang <> 'de' AND doc_id > min(doc_id) OVER (PARTITION BY lang = 'de', sha256(text)) AS repeated FROM documents""",
)
def repeated_pages(t: Tables):
    # Some pages have no text, and so no signature.
    docs = t.documents.select("doc_id", F.when(F.col("lang") != "de", F.sha2("text", 256)).alias("sha"))
    return frontier.repeated_pages(docs, F.col("sha"), "doc_id").select("doc_id", "first_seen", "repeated")


@query(
    "reconciliation",
    """SELECT count(*) AS discovered, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS intentionally_skipped,
  count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS failed, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS duplicate FROM orders""",
)
def reconciliation(t: Tables):
    state = (
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
        .when(F.col("o_orderstatus") == "P", "SKIPPED")
        .when(F.col("o_orderkey") % 2 == 0, "FAILED")
        .otherwise("DUPLICATE")
    )
    return frontier.reconciliation(t.orders.select(state.alias("status")))


@query(
    "date_boundary",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS ts FROM events),
stop AS (SELECT min(event_id) AS s FROM e WHERE ts >= TIMESTAMP '2024-01-12')
SELECT event_id, CAST(ts AS VARCHAR) AS published FROM e, stop WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-12' AND (s IS NULL OR event_id <= s)""",
)
def date_boundary(t: Tables):
    df = t.events.select(F.col("event_id").alias("_seq"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("published"))
    rows, _ = frontier.date_boundary(df, "published", "2024-01-04", "2024-01-12", "ASC", stop_when_older=True)
    return rows.select(F.col("_seq").alias("event_id"), F.col("published").cast("string").alias("published"))


@query(
    "date_boundary_report",
    """WITH e AS (SELECT event_id, ts FROM events), stop AS (SELECT min(event_id) AS s FROM e WHERE ts >= TIMESTAMP '2024-01-12'),
r AS (SELECT e.*, s FROM e, stop WHERE s IS NULL OR event_id <= s)
SELECT CAST(arg_max(ts, event_id) AS VARCHAR) AS last_seen, true AS ordering_proven, CASE WHEN max(s) IS NOT NULL THEN 'DATE_BOUNDARY_REACHED' END AS stop_reason,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-12') AS selected FROM r""",
)
def date_boundary_report(t: Tables):
    df = t.events.select(F.col("event_id").alias("_seq"), F.col("ts").alias("published"))
    _, report = frontier.date_boundary(df, "published", "2024-01-04", "2024-01-12", "ASC", stop_when_older=True)
    return report.withColumn("last_seen", F.col("last_seen").cast("string"))


@query(
    "lookback_window",
    """SELECT event_id, '2024-01-15' AS from_day, '2024-01-18' AS to_day FROM events
WHERE CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo') AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-18'""",
)
def lookback_window(t: Tables):
    clock = F.lit("2024-01-17T16:30:00").cast("timestamp_ntz")
    low, high = frontier.lookback_bounds(clock, 3, "Asia/Tokyo")
    return frontier.lookback_window(t.events, "ts", clock, 3, "Asia/Tokyo").select(
        "event_id", low.alias("from_day"), high.alias("to_day")
    )


@query(
    "budget_cutoff",
    """SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total, sum(n_chars) OVER () AS whole FROM documents WHERE doc_id % 4 <= 2) WHERE total <= 500000""",
)
def budget_cutoff(t: Tables):
    df = t.documents.select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("depth"))
    return frontier.budget_cutoff(df, "doc_id", max_bytes=500_000, size="n_chars", max_depth=2).select("doc_id")


@query(
    "attach_related",
    markup_queries.LINKED_ORACLE
    + markup_queries.NAV_LINKS
    + """ SELECT page_id, root || '/doc/' || page_id || '.pdf' AS url, CASE WHEN page_id % 3 = 0 THEN 'missing' ELSE 'attached' END AS state FROM root""",
)
def attach_related(t: Tables):
    from gleaner.operators import articles

    records = articles.article_record(markup_queries.linked(t)).select("page_id", F.col("attachments.url").alias("attachments"))
    documents = t.pages.where("page_id % 3 <> 0").select(
        urls.canonical_url(urls.resolve(F.col("url"), F.concat(F.lit("/doc/"), "page_id", F.lit(".pdf")))).alias("url")
    )
    attached, misses = frontier.attach_related(records, documents)
    return attached.select("page_id", "url", F.lit("attached").alias("state")).unionByName(
        misses.select("page_id", "url", F.lit("missing").alias("state"))
    )


@query(
    "attach_payload",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND c_custkey % 2 = 0 THEN c_mktsegment END AS related,
  CASE WHEN o_orderpriority LIKE '1%' AND c_custkey % 2 = 1 THEN '/api/' || o_custkey END AS related_error FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def attach_payload(t: Tables):
    payloads = t.customer.where("c_custkey % 2 = 0").select(
        F.concat(F.lit("/api/"), "c_custkey").alias("url"), F.col("c_mktsegment").alias("payload")
    )
    records = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("title"), "o_custkey")
    out = frontier.attach_payload(records, payloads, F.concat(F.lit("/api/"), "o_custkey"), "related", ["^1-URG"])
    return out.select("o_orderkey", "related", "related_error")


BUDGET_ORACLE = """
WITH u AS (SELECT doc_id, sum(1 + doc_id % 3) OVER w AS requests, sum(greatest(coalesce(n_chars, 0), 0)) OVER w AS bytes, sum(doc_id % 5) OVER w AS items,
  doc_id * 0.5::DOUBLE AS elapsed FROM documents WINDOW w AS (ORDER BY doc_id)),
b AS (SELECT doc_id, CAST(requests AS BIGINT) AS used_requests, CAST(bytes AS BIGINT) AS used_bytes, CAST(items AS BIGINT) AS used_items,
  CASE WHEN elapsed > 450 THEN 'BUDGET_DEADLINE_EXCEEDED' WHEN requests > 1700 THEN 'BUDGET_MAX_REQUESTS_EXCEEDED' WHEN bytes > 1000000 THEN 'BUDGET_MAX_BYTES_EXCEEDED'
  WHEN items > 300 THEN 'BUDGET_MAX_ITEMS_EXCEEDED' END AS cut FROM u)
"""


def spent(t: Tables):
    key = F.col("doc_id")
    limits = {"deadline": 450, "requests": 1700, "bytes": 1_000_000, "items": 300}
    uses = {"requests": 1 + key % 3, "bytes": F.col("n_chars"), "items": key % 5, "deadline": key * F.lit(0.5)}
    return frontier.budgeted(t.documents.select("doc_id", "n_chars"), limits, uses, "doc_id")


@query("budget_use", BUDGET_ORACLE + " SELECT doc_id, used_requests, used_bytes, used_items, cut FROM b")
def budget_use(t: Tables):
    return spent(t).select("doc_id", "used_requests", "used_bytes", "used_items", "cut")


@query(
    "budget_report",
    BUDGET_ORACLE
    + """ SELECT arg_min(cut, doc_id) FILTER (cut IS NOT NULL) AS reason, min(doc_id) FILTER (cut IS NOT NULL) AS cut_at, count(*) FILTER (cut IS NULL) AS kept,
  max(used_requests) FILTER (cut IS NULL) AS used_requests, max(used_bytes) FILTER (cut IS NULL) AS used_bytes, max(used_items) FILTER (cut IS NULL) AS used_items FROM b""",
)
def budget_report(t: Tables):
    return frontier.budget_report(spent(t), "doc_id").drop("used_deadline")


@query(
    "detail_order_ranked",
    """SELECT doc_id, row_number() OVER (ORDER BY published_at DESC, record_id DESC) AS place FROM (
  SELECT doc_id, coalesce(lang, '') AS published_at, CAST(doc_id AS VARCHAR) AS record_id FROM documents)""",
)
def detail_order_ranked(t: Tables):
    """Result order of a crawl, read back as places."""
    from gleaner.plans.ranking import running_total

    rows = t.documents.select("doc_id", F.col("lang").alias("published_at"), F.col("doc_id").cast("string").alias("record_id"))
    ordered = frontier.detail_order(rows).withColumn("at", F.monotonically_increasing_id())
    return running_total(ordered, ["at"], F.lit(1), "place").select("doc_id", "place")


@query(
    "repeated_addresses",
    CANON
    + """, p AS (SELECT page_id * 4 + v AS seq, page_id, v, canonical FROM canon),
f AS (SELECT *, min(seq) OVER (PARTITION BY canonical) AS first_address, CASE WHEN v < 2 THEN min(seq) OVER (PARTITION BY CASE WHEN v < 2 THEN page_id % 50 END, v < 2) ELSE seq END AS first_seen FROM p)
SELECT seq, first_seen, first_address, seq > first_seen OR seq > first_address AS repeated FROM f""",
)
def repeated_addresses(t: Tables):
    """Pages seen before by their canonical address or their text; some have no text."""
    pid = F.col("page_id")
    pages = url_table(t).select((pid * 4 + F.col("v")).alias("seq"), "page_id", "url", F.when(F.col("v") < 2, pid % 50).alias("text"))
    found = frontier.repeated_pages(pages, F.col("text"), "seq", F.col("url"))
    return found.select("seq", "first_seen", "first_address", "repeated")
