import json

from gleaner.functions import jsontext


def frame(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "id long, payload string")


DEEP = {"a": [{"x": 1}, {"x": "s", "y": None, "in": [[{"url": "/1"}], {"z": True}]}, 5], "b": []}
for _ in range(12):
    DEEP = {"d": DEEP}


def test_arrays_of_any_depth_without_a_job_while_planning(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    found = jsontext.nested_arrays(frame(spark, DEEP, None, "broken {", 5, [1, [2]]), "payload", ["id"])
    assert tracker.getJobIdsForGroup("planning") == []
    spark.sparkContext.setJobGroup("", "")
    top = "$" + ".d" * 12
    got = sorted((r["id"], r["path"], len(r["items"])) for r in found.collect())
    assert got == [(0, f"{top}.a", 3), (0, f"{top}.a[*].in", 2), (0, f"{top}.a[*].in[*]", 1), (0, f"{top}.b", 0), (4, "$", 2), (4, "$[*]", 1)]
    assert jsontext.nested_arrays(frame(spark, DEEP), "payload", ["id"], max_depth=5).count() == 0


def test_hints_name_the_fields_of_all_items(spark):
    rows = jsontext.schema_hints(frame(spark, {"a": [{"x": 1}, {"x": "s", "y": None, "t": [1]}, {"t": ["u", {"w": {}}]}, 7]}), "payload", "id").collect()
    assert sorted((r["json_path"], r["length"], r["fields"]) for r in rows) == [("$.a[*]", 4, "t:array,x:number|string,y:null"), ("$.a[*].t[*]", 1, "w:object")]


def test_urls_of_nested_lists(spark):
    data = frame(spark, DEEP, {"l": [{"href": "/a"}, "/b", "no", {"url": "", "link": "/c"}, {"href": "/a"}], "m": [{"u": [{"url": "/d"}]}]})
    got = sorted((r["id"], r["url"]) for r in jsontext.merge_url_lists(data, "payload", "id").collect())
    assert got == [(0, "/1"), (1, "/a"), (1, "/b"), (1, "/c"), (1, "/d")]
    assert [(r["id"], r["path"]) for r in jsontext.largest_url_list(frame(spark, {"l": [{"url": 1}], "m": [{"url": "a"}, {"url": "b"}]}), "payload", "id").collect()] == [(0, "$.m")]
