from pyspark.sql import functions as F

from gleaner.operators import dom, markup
from gleaner.operators.dom import parse


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://x.org/p{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


CARDS = """<main><article class="card"><h2><a href="/details/one">First <b>item</b></a></h2><span class=v>10</span></article>
<article class="card"><h2><a href='/details/two'>Second item</a></h2><span class=v>20</article></main>"""


def test_tree_closes_implied_elements():
    tree = parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<br>z<table><tr><td>1<td>2<tr><td>3</table>")
    shape = [(n.tag, n.depth, n.end) for n in tree.nodes]
    assert shape == [
        ("ul", 0, 5), ("li", 1, 1), ("li", 1, 4), ("ul", 2, 4), ("li", 3, 4), ("li", 1, 5), ("p", 0, 6), ("p", 0, 8), ("br", 1, 8),
        ("table", 0, 14), ("tr", 1, 12), ("td", 2, 11), ("td", 2, 12), ("tr", 1, 14), ("td", 2, 14),
    ]
    assert tree.text_of(tree.nodes[7]) == "y z"
    assert parse("<p>a<script>if (a<b) x</script>b").text_of(parse("<p>a").nodes[0]) in ("a", "a b")


def test_repeating_cards(spark):
    nodes = dom.dom_nodes(pages(spark, CARDS))
    out = markup.repeating_list(
        nodes,
        markup.matches("article", classes=["card"]),
        {
            "title": (markup.matches("a"), markup.node_value()),
            "url": (markup.matches("a", attributes={"href": None}), markup.node_value("href")),
            "value": (markup.matches("span", classes=["v"]), markup.node_value()),
        },
    )
    got = [tuple(r) for r in out.orderBy("node_id").select("title", "url", "value").collect()]
    assert got == [("First item", "/details/one", "10"), ("Second item", "/details/two", "20")]


def test_container_is_the_link_and_nested_containers(spark):
    html = '<div class=c><a class="card" href="/one">One</a><div class=c><i>in</i></div></div>'
    nodes = dom.dom_nodes(pages(spark, html))
    link = markup.repeating_list(nodes, markup.matches("a", classes=["card"]), {"url": (None, markup.node_value("href")), "t": (None, markup.node_value())})
    assert [tuple(r) for r in link.select("url", "t").collect()] == [("/one", "One")]
    nested = markup.repeating_list(nodes, markup.matches("div", classes=["c"]), {"i": (markup.matches("i"), markup.node_value())})
    assert [r["i"] for r in nested.orderBy("node_id").collect()] == ["in", "in"]


def test_table_spans_and_identity(spark):
    html = """<table id=m><tr><th>Bank<th>Rate<th>Rate<tr><td rowspan=2>A<td>1<td>2<tr><td colspan=2>3</table>
    <table><tr><td>h</td></tr><tr><td></td></tr><tr><td>v</td></tr></table>"""
    data = pages(spark, html)
    grid = dom.table_grid(data)
    first = markup.table_records(grid, data).orderBy("row_index").collect()
    assert [r["record"] for r in first] == [{"Bank": "A", "Rate": "1", "Rate_2": "2"}, {"Bank": "A", "Rate": "3", "Rate_2": "3"}]
    assert [(r["row_index"], r["table_id"], r["page_url"]) for r in first] == [(0, "table:0", "https://x.org/p0"), (1, "table:0", "https://x.org/p0")]
    second = markup.table_records(grid, table_index=1).collect()
    assert [(r["record"], r["table_id"]) for r in second] == [({"h": "v"}, "table:1")]
    assert markup.table_records(grid, table_index=9).count() == 2


def test_table_head_structures(spark):
    html = "<table><thead><tr><th colspan=2>Top</th></tr><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    row = markup.table_structures(dom.table_grid(pages(spark, html))).first()
    assert row["headers"] == ["a", "b"] and row["rows"] == [["1", "2"]] and row["matrix"][0] == ["Top", "Top"]


def test_card_clusters_prefer_cards(spark):
    card = '<article class="article-card"><a href="/{0}">Long enough headline number {0}</a> <p>Published 2024-01-0{0} with text</p></article>'
    html = "<nav>" + "".join(f'<a class="menu" href="/{i}">m{i}</a>' for i in range(6)) + "</nav>" + "".join(card.format(i) for i in range(1, 4))
    best = markup.card_clusters(dom.dom_nodes(pages(spark, html))).orderBy("rank").first()
    assert (best["selector"], best["count"], best["link_fraction"], best["signal_fraction"]) == ("article.article-card", 3, 1.0, 1.0)
    cards = markup.auto_cards(dom.dom_nodes(pages(spark, html)))
    assert cards.count() == 3


def test_linkless_panels_pass_by_signal(spark):
    panel = '<div class="offer-panel"><b>Deposit offer for a calm saver</b><i>rate 12,5 % in BYN</i><button>Open an account now</button></div>'
    found = markup.card_clusters(dom.dom_nodes(pages(spark, panel * 4))).withColumn("ok", markup.cluster_passes()).first()
    assert (found["selector"], found["count"], found["link_fraction"], found["ok"]) == ("div.offer-panel", 4, 0.0, True)


def test_rss_link_tail(spark):
    xml = "<rss><item><title>T &amp; U</title><link/>https://x.org/a\n<guid>g1</guid></item><item><title>V</title><link>https://x.org/b</link></item></rss>"
    got = [tuple(r) for r in markup.rss_items(pages(spark, xml)).orderBy("position").select("url", "title", "record_id").collect()]
    assert got == [("https://x.org/a", "T & U", "g1"), ("https://x.org/b", "V", None)]


def test_content_links_prefer_main(spark):
    html = """<header><a href=/h>h</a></header><div class="Breadcrumbs"><a href=/b>b</a></div><a href=/outside>o</a>
    <main><a href=/in>in</a><a href=/search/>s</a><a href="JavaScript:x()">j</a><nav><a href=/n>n</a></nav></main>"""
    data = pages(spark, html, "<a href=/only>x</a>")
    got = [tuple(r) for r in markup.content_links(dom.dom_nodes(data), data).orderBy("page_id").select("page_id", "url").collect()]
    assert got == [(0, "https://x.org/in"), (1, "https://x.org/only")]


def test_finish_cards(spark):
    data = pages(spark, "", "")
    cards = spark.createDataFrame(
        [(0, 5, "#", "a", "t"), (0, 9, "/x", "b", "t"), (1, 2, "/x", "b", "t"), (1, 7, "javascript:go()", "c", "t")],
        "page_id long, node_id int, url string, title string, text string",
    )
    got = [tuple(r) for r in markup.finish_cards(cards, data).orderBy("row_index").select("row_index", "url", "title").collect()]
    assert got == [(0, None, "a"), (1, "/x", "b"), (3, None, "c")]


def test_schema_first_modes(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "c", "c"), (2, None, "d")], "_seq long, x string, y string")
    spec = {"t": [{"id": "x", "path": "x", "required": True}, {"id": "y", "path": "y"}]}
    merged, errors = markup.schema_first(df, spec, selection="merge_non_conflicting")
    assert [r["t"] for r in merged.orderBy("_seq").collect()] == [None, "c", "d"]
    assert {(r["_seq"], r["code"]) for r in errors.collect()} == {(0, "CANDIDATE_CONFLICT"), (0, "FIELD_CANDIDATES_EXHAUSTED")}
    pinned, _ = markup.schema_first(df, spec, mode="MANUAL", pinned={"t": "y"})
    assert [r["t"] for r in pinned.orderBy("_seq").collect()] == ["b", "c", "d"]
    best, _ = markup.schema_first(df, spec, selection="best_coverage")
    assert [r["_evidence"]["t"]["id"] for r in best.orderBy("_seq").collect()] == ["x", "x", "y"]


def test_select_single(spark):
    nodes = dom.dom_nodes(pages(spark, "<p id=a>1</p><p>2</p>"))
    row = markup.select_elements(nodes, markup.matches("p"), markup.node_value(), single=True).first()
    assert (row["value"], row["count"]) == ("1", 2)
    assert markup.select_elements(nodes, markup.matches(id="a"), F.col("tag")).first()["value"] == "p"


def test_references_without_semicolon(spark):
    data = pages(spark, "<p title='a&amp b&lt;'>x &amp y &copyz &#38 &lt;i&gt; &amp;lt; &nosuch; &ampz;</p>")
    node = dom.dom_nodes(data, closed_references=True).first()
    assert node["text"] == "x &amp y &copyz &#38 <i> &lt; &nosuch; &ampz;" and node["attrs"] == {"title": "a&amp b<"}
    assert dom.dom_nodes(data).first()["text"] == "x & y ©z & <i> &lt; &nosuch; &z;"


def test_cluster_bar_before_rounding(spark):
    # 24 cards of 40 letters and one of 39: 39.96 on average, shown as 40.0.
    cards = "".join(f"<div class=offer><a href=/>{'x' * n}</a></div>" for n in [40] * 24 + [39])
    found = markup.card_clusters(dom.dom_nodes(pages(spark, cards)))
    row = found.where("selector = 'div.offer'").select("avg_text_length", markup.cluster_passes().alias("shown"), markup.cluster_passes(exact=True).alias("exact")).first()
    assert tuple(row) == (40.0, True, False)


def test_plain_tags_read_as_the_standard_parser_does(monkeypatch):
    texts = (
        "<ul><li class='a b' ID=x>1<li>2 &amp; 3<br/>4</ul>\n<a href=/q/>5</a><p>a<table><tr><td colspan=2>c</table> < tail &amp",
        "<i a=1 A=2 b>x</i><!-- <b> --><a t='x>y' href='?a&lt;b'>y</a></p><img src=z /><title><b></title><p>end",
    )
    plain = [list(dom._node_rows(t, None, "all", "all", closed)) for t in texts for closed in (False, True)]
    read = []
    monkeypatch.setattr(dom._Builder, "_plain", lambda self, text: read.append(text) or 0)
    assert plain == [list(dom._node_rows(t, None, "all", "all", closed)) for t in texts for closed in (False, True)] and len(read) == 4
    monkeypatch.undo()
    # A page of plain tags leaves nothing to the standard parser.
    builder = dom._Builder("<ul><li class='a b'>1<li>2 &amp; 3<br/>4</ul>")
    assert builder._plain(builder.source) == len(builder.source)
