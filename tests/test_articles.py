import json

from gleaner.operators import articles
from gleaner.operators.structure import element
from test_structure import pages

TWO = """<html lang=be><script type="application/ld+json">{"datePublished": "2020-01-01", "dateModified": "2024-01-02T03:04:05+03:00"}</script><body>
<h1></h1><h2 itemprop=headline>Head</h2><time>3 января 2024</time><article><p>one</p><a href=r.pdf></a></article><p>ads</p><article>two <a href=/s.pdf>s</a></article></body>"""


def one(frame):
    return frame.orderBy("page_id").first()


def test_first_article_and_first_date(spark):
    row = one(articles.article_record(pages(spark, TWO)))
    assert (row["title"], row["published_at"], row["body_text"], row["language"]) == ("Head", "2024-01-03", "one", "be")
    assert row["body_html"] == "<p>one</p><a href=r.pdf></a>" and row["source_modified_at"] == "2024-01-02T00:04:05Z"
    assert [tuple(a) for a in row["attachments"]] == [("r.pdf", "https://x.org/r.pdf")]


def test_paths_and_listing_come_first(spark):
    html = "<div class=t>Mine</div><b class=d>2024-02-03</b><div id=x>kept <div>in</div> tail<a href=/q>q</a></div><article>no</article><i>k</i><i>k </i><i>l</i>"
    data = pages(spark, html).selectExpr("*", "'Listed' AS listed", "'on 2023-05-06' AS day")
    paths = {
        "title": element("div", classes=["t"]), "date": element("b", classes=["d"]), "body": element("div", id="x"), "tags": element("i"),
        "attachments": element("div", id="x").descendant("a"),
    }
    row = one(articles.article_record(data, paths=paths, listing_title="listed"))
    assert (row["title"], row["published_at"], row["body_text"], row["tags"]) == ("Mine", "2024-02-03", "kept\n\nin\n\ntail\n\nq", "k|l")
    assert [tuple(a) for a in row["attachments"]] == [("q", "https://x.org/q")]
    row = one(articles.article_record(data, listing_title="listed", listing_date="day", attachment_base="https://y.org/"))
    assert (row["title"], row["published_at"], row["body_text"], row["attachments"]) == ("Listed", "2023-05-06", "no", [])


def test_pages_without_article(spark):
    rows = articles.article_record(pages(spark, "<body><p>a &amp; b", "", None, "<h1>T & U</h1>", "<article></article><main>m</main>")).orderBy("page_id").collect()
    assert [r["body_text"] for r in rows] == ["a & b", "https://x.org/p1", "https://x.org/p2", "T & U", "m"]
    assert [r["body_html"] for r in rows] == ["<p>a &amp; b", "<p>https://x.org/p1</p>", "<p>https://x.org/p2</p>", "<p>T &amp; U</p>", "m"]


def test_detail_fields(spark):
    html = """<div class=card><div>nested <b>x</b></div> rest</div><a class=l href=/a?utm_source=1>A</a><a class=l>none</a><a class=l href=/f/b.pdf></a>
    <table class=q><tr><th>h<th>h</tr><tr><td>1<td>2</tr></table><table><tr><td>other</tr></table><table class=q></table><time datetime="2024-01-02 03:04">t</time>"""
    data = pages(spark, html, "<p>").selectExpr("*", """'{"a": {"n": 5, "t": "<i>v</i> w 17", "l": ["x", null, " y  z "]}}' AS response""", "'L' AS item")
    found = articles.detail_records(
        data,
        [
            {"name": "card", "path": element("div", classes=["card"])},
            {"name": "inner", "path": element("div").child("div"), "value": "html"},
            {"name": "href", "path": element("a"), "attribute": "href"},
            {"name": "links", "path": element("a", classes=["l"]), "value": "links", "multiple": True},
            {"name": "attachments", "path": element("a", classes=["l"]), "value": "links", "multiple": True},
            {"name": "parts", "path": element("b"), "value": "html", "multiple": True},
            {"name": "tables", "path": element("table", classes=["q"]), "value": "structured_tables", "multiple": True},
            {"name": "source_published_at", "path": element("time"), "attribute": "datetime", "timezone": "Europe/Minsk", "format": "YYYY-MM-DD HH:mm"},
            {"name": "n", "source": "response", "source_path": "a.n"},
            {"name": "number", "source": "response", "source_path": "a.t", "value": "html_text", "regex": r"w (?P<the_number>\d+)"},
            {"name": "l", "source": "response", "source_path": "a.l", "value": "join", "separator": ";"},
            {"name": "listed", "source": "listing", "source_path": "item"},
        ],
        constants={"c": "k"}, listing_fields=["item"], attachment_base="https://y.org/d/",
    )
    row, empty = found.orderBy("page_id").collect()
    assert (row["card"], row["inner"], row["href"], row["parts"]) == ("nested x rest", "nested <b>x</b>", "/a?utm_source=1", ["x"])
    want = [("A", "https://y.org/a"), ("b.pdf", "https://y.org/f/b.pdf")]
    assert [tuple(a) for a in row["attachments"]] == want and [tuple(x.values()) for x in json.loads(row["links"])] == want
    assert [(t["table_index"], t["headers"], t["rows"], t["matrix"]) for t in row["tables"]] == [
        (0, ["h", "h_2"], [{"h": "1", "h_2": "2"}], [["h", "h"], ["1", "2"]]), (1, None, None, None)
    ] or [(t["table_index"], t["rows"]) for t in row["tables"]] == [(0, [{"h": "1", "h_2": "2"}]), (1, [])]
    assert (row["source_published_at"], row["n"], row["number"], row["l"], row["listed"], row["c"], row["item"]) == (
        "2024-01-02T00:04:00Z", "5", "17", "x;y  z".replace("  ", " "), "L", "k", "L",
    )
    assert (empty["card"], empty["attachments"], empty["parts"], empty["tables"], empty["n"], empty["url"]) == (None, [], [], None, "5", "https://x.org/p1")


def test_relative_attachments_are_resolved(spark):
    from gleaner.operators import frontier

    links = [f"f{i}.pdf" for i in range(30)] + ["/top.xlsx", "https://y.org/a.docx?utm_source=1", "no.html"]
    records = spark.createDataFrame([(1, "https://x.org/d/p", links), (2, "https://x.org/e/", ["f1.pdf"])], "page_id long, page string, attachments array<string>")
    known = ["https://x.org/d/f29.pdf", "https://x.org/top.xlsx", "https://y.org/a.docx"]
    attached, misses = frontier.attach_related(records, spark.createDataFrame([(u, "text") for u in known], "url string, text string"), page="page")
    assert sorted(r["url"] for r in attached.collect()) == sorted(known)
    assert misses.count() == 30 and misses.where("page_id = 2").first()["url"] == "https://x.org/e/f1.pdf"


def test_title_with_cut_reference(spark):
    data = pages(spark, "<h1>a &amp b&amp</h1><article><p>c&amp</p></article>")
    row = one(articles.article_record(data, closed_references=True))
    assert (row["title"], row["body_text"]) == ("a &amp b&amp", "c&amp")
