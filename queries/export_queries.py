"""Export row sets and sources derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.sources import readers, sinks
from queries.process_queries import DOC_LINES_ORACLE, doc_lines
from queries.registry import Tables, query


@query(
    "export_flat",
    DOC_LINES_ORACLE
    + """ SELECT doc_id, '[' || string_agg('{"line_no":' || line_no || ',"size":' || size || '}', ',' ORDER BY item) || ']' AS lines, 't' AS title FROM lines GROUP BY doc_id""",
)
def export_flat(t: Tables):
    df = doc_lines(t).select(
        F.lit("t").alias("title"),
        "doc_id",
        F.transform("lines", lambda x: F.struct(x["line_no"], x["size"])).alias("lines"),
        F.lit("hidden").alias("evidence"),
        F.lit("x").alias("_provenance"),
    )
    return sinks.flat_columns(df)


def rich_records(t: Tables):
    """Documents as records with tables, attachments and an API payload, built from their lines."""
    cells = lambda x: F.create_map(F.lit("size"), x["size"].cast("string"), F.lit("flag"), x["flag"])
    sheet = F.struct(
        F.lit("s1").alias("name"), F.transform("lines", lambda x: F.array(x["size"].cast("string"), x["flag"])).alias("rows")
    )
    pages = F.transform(
        "lines", lambda x: F.struct(x["line_no"].alias("page"), F.when(x["size"] > 0, x["flag"]).otherwise("").alias("text"))
    )
    document = F.struct(F.lit("f.pdf").alias("filename"), pages.alias("pages"), F.array(sheet).alias("sheets"))
    return doc_lines(t).select(
        F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("doc "), "doc_id").alias("title"),
        F.array(F.struct(F.lit(0).alias("table_index"), F.transform("lines", cells).alias("rows"))).alias("tables"),
        F.array(
            F.struct(F.lit("a").alias("title"), F.lit("/a").alias("url"), F.when(F.col("doc_id") % 2 == 0, document).alias("document"))
        ).alias("attachments"),
        F.struct(F.transform("lines", lambda x: F.struct(x["code"].alias("code"))).alias("records")).alias("official_api"),
    )


@query(
    "export_nested_rows",
    DOC_LINES_ORACLE
    + """ SELECT 'table' AS sheet, CAST(doc_id AS VARCHAR) AS external_id, item AS row_index, size || '/' || flag AS value FROM lines
UNION ALL SELECT 'page', CAST(doc_id AS VARCHAR), line_no, flag FROM lines WHERE size > 0 AND doc_id % 2 = 0
UNION ALL SELECT 'sheet', CAST(doc_id AS VARCHAR), item, size || '/' || flag FROM lines WHERE doc_id % 2 = 0
UNION ALL SELECT 'api', CAST(doc_id AS VARCHAR), NULL, CAST(code AS VARCHAR) FROM lines""",
)
def export_nested_rows(t: Tables):
    records = rich_records(t)
    tables = sinks.table_sheet(records).select(
        F.lit("table").alias("sheet"), "external_id", F.col("row_index").cast("bigint").alias("row_index"),
        F.concat(F.col("row")["size"], F.lit("/"), F.col("row")["flag"]).alias("value"),
    )
    parts = sinks.attachment_sheet(records)
    pages = parts.where("document_page is not null").select(
        F.lit("page").alias("sheet"), "external_id", F.col("document_page").alias("row_index"), F.col("document_text").alias("value")
    )
    rows = parts.where("sheet is not null").select(
        F.lit("sheet").alias("sheet"), "external_id", F.col("document_row_index").cast("bigint").alias("row_index"),
        F.array_join("cells", "/").alias("value"),
    )
    api = sinks.api_sheet(records).select(
        F.lit("api").alias("sheet"), "external_id", F.lit(None).cast("bigint").alias("row_index"), F.col("record.code").cast("string").alias("value")
    )
    return tables.unionByName(pages).unionByName(rows).unionByName(api)


@query(
    "export_summary",
    DOC_LINES_ORACLE
    + """ SELECT CAST(doc_id AS VARCHAR) AS external_id, '1 tables / ' || count(*) || ' rows' AS tables, '1 attachments / ' || CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END || ' parsed' AS attachments,
  'official API: ' || count(*) || ' records' AS official_api FROM lines GROUP BY doc_id""",
)
def export_summary(t: Tables):
    return rich_records(t).select(
        "external_id",
        sinks.tables_summary(F.col("tables")).alias("tables"),
        sinks.attachments_summary(F.col("attachments")).alias("attachments"),
        sinks.api_summary(F.col("official_api")).alias("official_api"),
    )


@query(
    "csv_documents",
    DOC_LINES_ORACLE + " SELECT doc_id, item AS row_index, size, flag, 'a; b,' || chr(13) || chr(10) || 'c \"d\"' AS note FROM lines",
)
def csv_documents(t: Tables):
    # Columns in either order, an unknown one, quoted line breaks and separators, two separators.
    even = F.col("doc_id") % 2 == 0
    note = '"a; b,\r\nc ""d"""'
    first = F.transform("lines", lambda x: F.concat(x["size"].cast("string"), F.lit(f";{note};"), x["flag"]))
    second = F.transform("lines", lambda x: F.concat(x["flag"], F.lit(","), x["size"].cast("string"), F.lit(f",{note}")))
    text = F.when(even, F.concat(F.lit("\ufeffsize;note;flag\r\n"), F.array_join(first, "\r\n"), F.lit("\r\n"))).otherwise(
        F.concat(F.lit("flag,size,note\n"), F.array_join(second, "\n"))
    )
    docs = doc_lines(t).select("doc_id", text.alias("body"))
    return readers.parse_csv_column(docs, "body", "size bigint, flag string, note string").select(
        "doc_id", F.col("row_index").cast("bigint").alias("row_index"), "record.size", "record.flag", "record.note"
    )


@query(
    "json_documents",
    DOC_LINES_ORACLE
    + " SELECT doc_id, item AS row_index, size FROM lines WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, doc_id FROM documents WHERE doc_id % 2 = 1",
)
def json_documents(t: Tables):
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.transform("lines", lambda x: F.struct(x["size"].alias("n"))))).otherwise(
        F.concat(F.lit('{"n":'), "doc_id", F.lit("}"))
    )
    docs = readers.parse_json_column(doc_lines(t).select("doc_id", body.alias("body")), "body")
    return docs.select(
        "doc_id", F.col("row_index").cast("bigint").alias("row_index"), F.try_variant_get("record", "$.n", "bigint").alias("size")
    )


@query(
    "upsert_table",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
)
def upsert_table(t: Tables):
    existing = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal")
    batch = t.customer.where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("id"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment"
    )
    rows = sinks.prepare_for_table(batch, existing.columns, {"id": "c_custkey"})
    return sinks.upsert_rows(existing, rows, ["c_custkey"])
