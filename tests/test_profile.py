from gleaner.operators import dom, profile

PAGE = """<div class="hit box big">x</div><ul>
<li class="box hit"><a href="/1"> </a><h2 class="name">One</h2><img src=i.png class="pic"><time datetime="2024-01-01">d</time></li>
<li class="box hit"><a href="/2">Two</a><h2>Two</h2></li></ul>"""


def nodes(spark, *htmls):
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return dom.dom_nodes(rows, text_for=("a",))


def test_xpath_is_that_of_the_first_element_a_selector_matches(spark):
    got = {r["css"]: r for r in profile.selector_candidates(nodes(spark, PAGE)).collect()}
    one = "[contains(concat(' ', normalize-space(@class), ' '), ' {} ')]"
    assert got["li.box"]["xpath"] == "//li" + one.format("box") + one.format("hit") and got["li.box"]["count"] == 2
    # An earlier element has all its classes and one more.
    assert got[".box.hit"]["xpath"] == "//div" + "".join(one.format(c) for c in ("hit", "box", "big"))
    assert all(0.5 <= r["confidence"] <= 1 for r in got.values())


def test_extractor_fields(spark):
    rows = profile.suggested_extractor(nodes(spark, PAGE, "<p>no lists</p>", "")).collect()
    assert [r["page_id"] for r in rows] == [0]
    assert rows[0]["candidate_count"] == 2 and rows[0]["follow_links"]
    assert [tuple(f) for f in rows[0]["fields"]] == [
        ("url", "a[href]", "href"), ("title", ".name", None), ("image", ".pic", "src"), ("source_published_at", "time", "datetime"),
    ]
