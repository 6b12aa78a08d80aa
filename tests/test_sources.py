import json

import pytest
from pyspark.sql import functions as F

from gleaner.context import RunContext, merge_review_policy
from gleaner.operators import ops
from gleaner.sources import pages, readers, sinks


def test_constants_and_run_input(spark):
    ctx = RunContext("r9", "2024-01-01T00:00:00", variables={"city": "Minsk"})
    rows = readers.constant_records(spark, [{"a": 1, "b": "in {{city}} {{none}}"}, "x"], ctx).collect()
    assert [(r["a"], r["b"], r["value"]) for r in rows] == [(1, "in Minsk ", None), (None, None, "x")]
    assert readers.run_input(spark, ctx).first().asDict() == {"run_id": "r9", "city": "Minsk"}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;rate\nA;1,5\n\"B;C\";2\n".encode())
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), ";")
    assert [tuple(r) for r in df.collect()] == [("A", "1,5"), ("B;C", "2")] and df.columns == ["name", "rate"]
    assert readers.sniff_separator("a\tb\n1\t2") == "\t"


def test_json_and_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "o.json").write_text(json.dumps({"a": 3}))
    (tmp_path / "t.csv").write_text("a\n4\n")
    assert sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / "*.json"), multi_line=True).collect()) == [1, 2, 3]
    docs = readers.read_binary(spark, str(tmp_path))
    assert docs.count() == 3
    rows = readers.document_collection(docs, "a int").select("record", "_document.filename", "_document.index").collect()
    assert sorted((json.loads(r[0])["a"], r[1], r[2]) for r in rows) == [(1, "l.json", 0), (2, "l.json", 1), (3, "o.json", 0), (4, "t.csv", 0)]


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>https://x/1</link><guid isPermaLink='false'>g</guid></item><item><title>no link</title></item></channel></rss>")
    assert [tuple(r) for r in readers.read_feed(spark, str(tmp_path / "f.xml")).collect()] == [("https://x/1", "T", "g")]


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "s")], "b int, a array<int>, _side string").coalesce(1)
    sinks.export_csv(df, str(tmp_path / "csv"), byte_order_mark=True)
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8")
    assert text == '﻿a,b\n"[1,2]",1\n'
    sinks.export_json(df, str(tmp_path / "json"))
    assert json.loads(next((tmp_path / "json").glob("part-*")).read_text()) == {"a": [1, 2], "b": 1}


def test_table_checks(spark):
    assert sinks.check_table("t", ["public.t"]) == "public.t"
    for bad in ("t;drop", "other"):
        with pytest.raises(ValueError):
            sinks.check_table(bad, ["t"])


def test_legacy_encoding(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    try:
        word = "Привет мир"
        df = spark.createDataFrame([(word.encode("cp1251"),), (word.encode(),)], "c binary")
        assert [r[0] for r in df.select(pages.repair_encoding(F.col("c"))).collect()] == [word, word]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
        spark.conf.unset("spark.sql.legacy.codingErrorAction")


def test_artifact_link_prefers_own_run(spark):
    raw = spark.createDataFrame([("d1", "r1", "s", 1), ("d2", "r1", "s", 2), ("d3", "r2", "s", 3)], "id string, run_id string, sha256 string, created_at int")
    items = spark.createDataFrame([(0, "r1", "d1", "s"), (1, "r1", "d3", "s"), (2, "r3", None, "s")], "_seq int, run_id string, raw_document_id string, artifact_sha256 string")
    got = {r["_seq"]: r["raw_document_id"] for r in pages.link_artifacts(items, raw).collect()}
    assert got == {0: "d1", 1: "d2", 2: None}


def test_redaction_depth(spark):
    df = spark.createDataFrame([({"Token": "a", "note": "my secret1"}, [("secret1", "x")], "k")], "m map<string,string>, s array<struct<text:string,password:string>>, api_key string")
    row = ops.redact_frame(df, ["secret1", "se"]).first()
    assert row["m"] == {"Token": "[REDACTED]", "note": "my [REDACTED]"}
    assert tuple(row["s"][0]) == ("[REDACTED]", "[REDACTED]") and row["api_key"] == "[REDACTED]"


def test_policy_levels():
    assert merge_review_policy({"new": True}, None, {"changed": True, "new": False})["new"] is False


def test_cron_fields(spark):
    df = spark.createDataFrame([("1-10/3,50",), ("*/30",), ("7",)], "f string")
    assert [r[0] for r in df.select(ops.cron_values(F.col("f"), 0, 59)).collect()] == [[1, 4, 7, 10, 50], [0, 30], [7]]


def test_csv_fields_of_any_length(spark):
    long = "x," * 100_000
    df = spark.createDataFrame([(1, f'a,b\n1,"{long}"\n2,{"y" * 300_000}\n')], "id int, text string")
    rows = readers.parse_csv_column(df, "text", "a int, b string", ",").orderBy("row_index").select("record").collect()
    assert [(r["record"]["a"], r["record"]["b"]) for r in rows] == [(1, long), (2, "y" * 300_000)]
