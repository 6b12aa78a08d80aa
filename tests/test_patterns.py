import warnings

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import java_groups, regex_pick
from gleaner.operators import frontier


def test_groups_are_renamed_in_order():
    assert java_groups(r"(?P<record_id>a)(?P<b>.)(?P=record_id)") == r"(?<g1>a)(?<g2>.)\k<g1>"
    assert java_groups(r"\(?P<x>(?P<y_z>\\(?P<w>q))") == r"\(?P<x>(?<g1>\\(?<g2>q))"


def test_underscored_groups_pick(spark):
    df = spark.createDataFrame([("id pr12 at 2024",), (None,), ("none",)], "v string")
    got = df.select(regex_pick(F.col("v"), r"(?P<record_id>pr\d+) at (?P<the_year>\d+)", 2, default="-")).collect()
    assert [r[0] for r in got] == ["2024", None, "-"]


def test_a_bad_pattern_says_so(spark):
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.warns(UserWarning, match="not a pattern"):
        assert df.select(regex_pick(F.col("v"), "(", 0)).first()[0] is None
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        df.select(regex_pick(F.col("v"), "(?P<a_b>x)", 0)).first()


def test_frontier_with_underscored_groups(spark):
    items = spark.createDataFrame([(0, "https://x.org/press/releases/pr7/2024-01-02T03:04:05"), (1, "https://x.org/press/news/pr8/2024-01-02T03:04:05")], "_seq long, url string")
    pattern = r"/press/releases/(?P<record_id>pr[^/?#]+)/(?P<publication_time>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})$"
    row = frontier.url_frontier(items, {"url_pattern": pattern}, F.lit("https://x.org/"), F.lit("https://x.org/")).collect()
    assert [(r["record_id"], r["publication_time"]) for r in row] == [("pr7", "2024-01-02T03:04:05")]
