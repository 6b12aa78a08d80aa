import pytest
from pyspark.sql import functions as F

from gleaner.context import RunContext
from gleaner.functions.formula import check_formula, signed_modulo
from gleaner.operators import assure, collection, dedupe, rules
from gleaner.operators.process import apply_operations, map_fields, merge_branches

CTX = RunContext("r1", "2024-01-10T00:00:00", {"id": "s"})


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_unpivot_golden(spark):
    df = spark.createDataFrame([(0, "P", "BYN", "12", "")], "_seq long, name string, cur string, `term:32-61` string, `term:62-91` string")
    out = apply_operations(
        df,
        [{"type": "unpivot", "idFields": ["name", "cur"], "dimensionColumns": {"selector": "term:*", "headerTarget": "term", "valueTarget": "rate"}}],
    )
    assert rows(out, "name", "cur", "term", "rate") == [("P", "BYN", "32-61", "12"), ("P", "BYN", "62-91", "")]
    skipped = collection.unpivot_columns(df, ["name"], "term:*", skip_empty=True)
    assert skipped.count() == 1
    assert skipped.first()["_collection"]["source_column"] == "term:32-61"


def test_explode_null_scalar_and_list(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, None), (2, [])], "_seq long, xs array<string>")
    assert rows(collection.explode_field(df, "xs", "x"), "_seq", "x") == [(0, "a"), (0, "b")]
    scalar = spark.createDataFrame([(0, "a"), (1, None)], "_seq long, x string")
    assert rows(collection.explode_field(scalar, "x"), "_seq", "x") == [(0, "a")]


def test_effective_revision_unchanged_group(spark):
    df = spark.createDataFrame(
        [(0, "a", "2024-01-01", "2024-02-01"), (1, "a", "2024-01-05", None), (2, "b", "2025-01-01", None), (3, None, None, None)],
        "_seq long, k string, effective_from string, effective_to string",
    )
    out = apply_operations(df, [{"type": "select_effective_revision", "partitionBy": ["k"]}], CTX)
    assert rows(out, "_seq") == [(1,), (2,), (3,)]
    assert rows(apply_operations(df, [{"type": "select_effective_revision"}], CTX), "_seq") == [(1,)]
    late = df.where("_seq = 2")
    assert rows(apply_operations(late, [{"type": "select_effective_revision"}], CTX), "_seq") == [(2,)]


def test_first_wins_with_null_keys(spark):
    df = spark.createDataFrame([(3, None, "x"), (1, None, "y"), (2, "k", "z"), (4, "k", "w")], "_seq long, k string, v string")
    assert rows(dedupe.keep_first(df, ["k"]), "_seq", "v") == [(1, "y"), (2, "z")]
    assert rows(dedupe.dedupe_decisions(df, ["k"]).where("not _kept"), "_seq") == [(3,), (4,)]
    same = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "_seq long, v string")
    assert rows(dedupe.keep_first(same), "_seq") == [(1,), (3,)]


def test_rules_and_access(spark):
    df = spark.createDataFrame(
        [(0, "Новости БАНКА", "body", "u1"), (1, "Реклама", "b", "u2")], "_seq long, title string, body_text string, canonical_url string"
    )
    out = apply_operations(
        df,
        [
            {
                "type": "select_by_rules",
                "fields": ["title"],
                "rules": [
                    {"id": "bank", "action": "include", "when": {"anyPatterns": ["банк"]}},
                    {"id": "ad", "action": "exclude", "reason": "advert", "when": {"regex": True, "anyPatterns": ["^реклама$"]}},
                ],
            },
            {"type": "classify_access", "fields": ["title"], "rules": [{"status": "PAYWALLED", "when": {"anyPatterns": ["новости"]}}], "redactFields": ["body_text"]},
        ],
    )
    assert rows(out, "candidate_status", "selection_reason", "access_status", "body_text") == [
        ("EXCLUDE", "advert", "PUBLIC", "b"),
        ("INCLUDE", "bank", "PAYWALLED", None),
    ]


def test_rule_evidence_names_terms_and_fields(spark):
    df = spark.createDataFrame([(0, "cheap fish"), (1, None)], "_seq long, title string")
    rule = {"when": {"anyPatterns": ["fish"]}}
    out = rules.select_by_rules(df, {"fields": ["title", "absent"], "rules": [{**rule, "action": "include"}]})
    out = rules.classify_access(out, {"rules": [{**rule, "status": "PAYWALLED"}]})
    fields = ("selection_evidence.matched_terms", "selection_evidence.fields", "access_evidence.matched_terms", "access_evidence.fields")
    found = [tuple(r) for r in out.orderBy("_seq").select(*[F.col(c).alias(str(i)) for i, c in enumerate(fields)]).collect()]
    assert found == [(["fish"], ["title", "absent"], ["fish"], []), ([], ["title", "absent"], [], [])]


def test_condition_sends_null_to_false(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "_seq long, n int")
    yes, no = rules.route(df, "n", "gt", 2)
    assert rows(yes, "_seq") == [(1,)] and rows(no, "_seq") == [(2,), (3,)]
    assert rules.route(df, "n", "ne", 5)[0].count() == 2


def test_rename_copy_split_and_missing(spark):
    df = spark.createDataFrame([(0, "a,b", '{"x":{"y":[1,2]}}')], "_seq long, v string, j string")
    out = apply_operations(
        df,
        [
            {"type": "split", "field": "v", "to": "parts"},
            {"type": "copy", "source": "parts[1]", "to": "second"},
            {"type": "copy", "source": "j.x.y[1]", "to": "deep"},
            {"type": "rename", "field": "gone", "to": "nothing"},
            {"type": "unknown"},
        ],
    )
    assert rows(out, "second", "deep", "nothing") == [("b", "2", None)]


def test_mapping_errors(spark):
    df = spark.createDataFrame([(0, None, 4.0, 0.0), (1, "x", 4.0, 2.0)], "_seq long, a string, n double, d double")
    records, errors = map_fields(
        df, [{"target": "a", "required": True}, {"target": "q", "expression": "try_divide(n, d)"}, {"name": ""}, {"target": "c", "constant": 1}]
    )
    assert rows(records, "_seq", "q", "c") == [(0, None, 1), (1, 2.0, 1)]
    assert rows(errors, "_seq", "field", "code") == [
        (0, "a", "REQUIRED"), (0, "q", "EXPRESSION"), (0, None, "TARGET_REQUIRED"), (1, None, "TARGET_REQUIRED"),
    ]


def test_formula_allow_list(spark):
    check_formula("case when a > 1 then upper(b) else 'reflect(x)' end")
    for bad in ("reflect('java.lang.System', 'exit')", "(select 1)", "java_method('x')", "a; b"):
        with pytest.raises(ValueError):
            check_formula(bad)
    df = spark.createDataFrame([(-7, 3), (7, -3), (7, 3)], "a int, b int")
    assert [r[0] for r in df.select(signed_modulo(F.col("a"), F.col("b"))).collect()] == [-7 % 3, 7 % -3, 7 % 3]


def test_assessment_states(spark):
    df = spark.createDataFrame([(0, "a"), (1, "")], "_seq long, v string")
    checked = assure.with_errors(df, assure.required_checks(df, ["v"]))
    row = assure.assess(checked, assure.Expectations(quarantine=True)).first()
    assert (row["status"], row["records_left"], row["codes"], row["commit_allowed"]) == ("PARTIAL", 1, "REQUIRED", False)
    empty = checked.where("_seq > 5")
    assert assure.assess(empty, assure.Expectations()).first()["status"] == "FAIL"
    allowed = assure.assess(empty, assure.Expectations(allow_empty=True)).first()
    assert (allowed["status"], allowed["codes"]) == ("PASS", "EMPTY_VALID_WINDOW")


def test_branch_merge(spark):
    left = spark.createDataFrame([(1, "a")], "k int, a string")
    right = spark.createDataFrame([(2, "b")], "k int, b string")
    assert rows(merge_branches(left, right), "k", "a", "b") == [(1, "a", None), (2, None, "b")]
