import pytest
from pyspark.sql import functions as F

from gleaner.operators import dom, structure
from gleaner.operators.dom import parse
from gleaner.operators.structure import Field, element, scope

PAGE = """<body><div class=a id=top><ul><li>1</li><li class=x><div class=a><a href="/in">in <b>2</b></a></div><p>3</p>tail</ul><p>4<p>5
</div><ul><li><a href="/out.pdf">out</a></li></ul><p>6</p></body>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://x.org/p{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_source_of_elements():
    tree = parse(PAGE)
    shown = {(n.tag, PAGE[slice(*n.outer)], PAGE[slice(*n.inner)]) for n in tree.nodes if n.tag in ("li", "a", "b", "p")}
    assert ("b", "<b>2</b>", "2") in shown and ("a", '<a href="/in">in <b>2</b></a>', "in <b>2</b>") in shown
    assert ("p", "<p>4", "4") in shown and ("p", "<p>5\n", "5\n") in shown and ("li", "<li>1</li>", "1") in shown
    assert ("li", '<li class=x><div class=a><a href="/in">in <b>2</b></a></div><p>3</p>tail', '<div class=a><a href="/in">in <b>2</b></a></div><p>3</p>tail') in shown
    assert [n.tag for n in parse("<p>x<br/>y</p").nodes] == ["p", "br"]


@pytest.mark.parametrize(
    ("path", "found"),
    [
        (element("div", classes=["a"]).descendant("ul").descendant("a"), ["in 2"]),
        (element("div").child("ul").child("li"), ["1", "in 2 3 tail"]),
        (element("div").child("a"), ["in 2"]),
        (element(id="top").child("a"), []),
        (element("ul").child("li").child("p"), ["3"]),
        (element("ul").next("p"), ["4", "6"]),
        (element("ul").later("p"), ["4", "5", "6"]),
        (element("div", id="top").later().descendant("a", attributes={"href": ("$=", ".pdf")}), ["out"]),
        (element("li").next("li", classes=["x"]).descendant("b"), ["2"]),
        (element("a", attributes={"href": ("^=", "/in")}), ["in 2"]),
    ],
)
def test_steps(spark, path, found):
    nodes = dom.dom_nodes(pages(spark, PAGE, "", None, "<p>none"))
    rows = structure.select(nodes, path).orderBy("page_id", "node_id").collect()
    assert [r["value"] for r in rows] == found
    assert all(r["evidence"]["css_selector"] == path.css() and r["page_id"] == 0 for r in rows)


def test_modes_and_groups(spark):
    nodes = dom.dom_nodes(pages(spark, PAGE), html_for=("a",))
    path = element("div").descendant("a")
    assert structure.select(nodes, path, "html", single=True).first()["value"] == '<a href="/in">in <b>2</b></a>'
    both = structure.select(nodes, [path, element("ul").descendant("a", attributes={"href": ("*=", "out")})], "@href", single=True).first()
    assert (both["value"], both["count"], both["evidence"]["css_selector"]) == ("/in", 2, "div a, ul a[href*='out']")


def test_one_exchange_for_a_path_of_any_length(spark):
    nodes = dom.dom_nodes(pages(spark, PAGE))
    plan = structure.reach(nodes, {"hit": element("div").child("ul").descendant("li").next("li").child("div")})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text


def test_repeating_with_scope_nested_and_evidence(spark):
    html = """<section class=s><h2><a href=/1>one</a></h2><div><h2><a href=/deep>deep</a></h2></div>
    <section class=s><h2><a href=/2>two</a></h2><i data-v=7></i></section></section>"""
    nodes = dom.dom_nodes(pages(spark, html), html_for=("h2",))
    fields = {
        "link": Field(scope().child("h2").child("a"), "@href"),
        "html": Field(scope().child("h2"), "html"),
        "v": Field(element("i"), "@data-v", "none"),
        "last": Field(element("section").child("section").descendant("a")),
        "missing": Field(scope().child("i"), "@x", "unused"),
        "absent": Field(scope().child("b"), default="d"),
        "id": Field(mode="@class"),
    }
    rows = structure.repeating(nodes, element("section", classes=["s"]), fields).orderBy("node_id").collect()
    got = [tuple(r)[2:9] for r in rows]
    assert got == [
        ("/1", "<h2><a href=/1>one</a></h2>", "7", "two", "unused", "d", "s"),
        ("/2", "<h2><a href=/2>two</a></h2>", "7", "two", None, "d", "s"),
    ]
    notes = rows[1]["evidence"]
    assert set(notes) == {"link", "html", "v", "last", "missing", "id"}
    assert notes["link"]["css_selector"] == "section.s :scope > h2 > a" and notes["id"]["css_selector"] == "section.s" and notes["v"]["text"] == "7"


TABLES = """<table><tr><th>wrong</tr><tr><td>0</tr></table><div><table class=data><tr><th>Bank Name<th>Rate</tr><tr><td>A<td>1</tr></table></div>
<table class=data><tr><th>Bank Name<th><th>Rate</tr><tr><td>B<td>2<td>3</tr></table>"""


def test_table_by_selector(spark):
    data = pages(spark, TABLES, "<p>none</p>")
    grid, nodes = dom.table_grid(data), dom.dom_nodes(data)
    read = lambda i: structure.parse_tables(data, grid, nodes, element("table", classes=["data"]), i)
    records, said = read(0)
    assert [(r["record"], r["table_id"], r["row_index"]) for r in records.collect()] == [({"Bank Name": "A", "Rate": "1"}, "table.data:0", 0)]
    first, none = said.orderBy("page_id").collect()
    assert [tuple(c) for c in first["columns"]] == [(0, "Bank Name", "A"), (1, "Rate", "1")] and first["error"] is None
    assert [tuple(m) for m in first["mapping_draft"]] == [("Bank Name", "bank_name"), ("Rate", "rate")]
    assert (none["columns"], none["error"]) == (None, "TABLE_NOT_FOUND")
    assert read(1)[0].first()["record"] == {"Bank Name": "B", "column_2": "2", "Rate": "3"} and read(1)[0].first()["table_id"] == "table.data:1"
    assert read(9)[0].first()["record"] == {"Bank Name": "A", "Rate": "1"}


def test_wide_spans_are_flagged(spark):
    html = f"<table><tr><td colspan=1500>a<td>b</tr><tr><td colspan={'9' * 5000} rowspan={'9' * 5000}>c<td>d</tr><tr><td colspan=0x>e</tr></table>"
    rows = dom.table_grid(pages(spark, html)).orderBy("row_index").select(F.size("cells").alias("n"), "cut").collect()
    assert [(r["n"], r["cut"]) for r in rows] == [(1001, True), (1001, True), (1001, False)]


def test_scripts_and_styles_keep_the_rest_of_a_page_plain():
    """What follows them is read by the one pattern; their ends are those of the standard parser."""

    class Standard(dom._Builder):
        def _plain(self, text):
            return 0

    def nodes(kind, html):
        tree = kind(html)
        tree.read()
        return [(n.tag, n.end, n.outer, n.inner, tree.text_of(n)) for n in tree.nodes]

    page = '<html><head><SCRIPT type="a">if (x<1) "<p>"</Script><style>b{}</style></head><body><p>1</p></body></html>'
    assert dom._Builder(page)._plain(page) == len(page)
    for html in (page, "<script>a</script >b<p>", "<script>a<!--</script>--></script><p>b", "<script>a</scriptx><p>", "<style/><p>a</style>b", "<p>a<style>"):
        assert nodes(dom._Builder, html) == nodes(Standard, html)
