"""Article and detail records from parsed nodes, one pass over each page's nodes.

Every fact of a page is the first hit of a rule in page order, so all of them are one aggregation
by page of ``min_by`` over node ids, with partial results before the exchange.  Chains of rules that ask for
the first element of the first rule fold (rule, node id) in the same way.  Lists, such as links
with titles, gather a page's hits only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup, urls
from gleaner.functions.dates import publication_date, source_datetime
from gleaner.functions.records import path_column
from gleaner.functions.text import clean_inline, is_blank, non_blank, regex_pick, unique_strings
from gleaner.operators import dom, structure
from gleaner.operators.structure import Path, content, reach

# Classes and item properties that mark an article's body, and document suffixes.
BODY_CLASSES = ("article-body", "post-content", "entry-content")
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip")
# Fixed value: record fields that hold a moment of the source.
DATE_FIELDS = ("source_published_at", "source_modified_at")


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _is(name: str, value: str) -> Column:
    return F.coalesce(_attribute(name) == value, F.lit(False))


def _first(value: Column, hit: Column) -> Column:
    """Value of the first node with a hit; the struct keeps an element without a value."""
    return F.min_by(F.struct(value.alias("v")), F.when(hit, F.col("node_id")))["v"]


def _first_rule(value: Column, rules: Sequence[Column]) -> Column:
    """Value of the first element of the first rule that has one."""
    number = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules))):
        number = F.when(rule, n).otherwise(number)
    return F.min_by(value, F.when(number.isNotNull(), F.struct(number.alias("rule"), F.col("node_id"))))


def _listed(hit: Column, *columns: Column) -> Column:
    """All hits of a page in order."""
    return F.sort_array(F.collect_list(F.when(hit, F.struct("node_id", *columns))))


def _moment() -> Column:
    return F.coalesce(non_blank(_attribute("datetime")), non_blank(_attribute("content")), non_blank(F.col("text")))


def _linked(page: Column, links: Column) -> Column:
    """(title, url) of links; a link without text is called after its file."""

    def one(link: Column) -> Column:
        title = F.coalesce(non_blank(link["text"]), F.regexp_extract(urls.path(link["href"]), "([^/]*)$", 1))
        return F.struct(title.alias("title"), urls.canonical_url(urls.resolve(page, link["href"])).alias("url"))

    return F.transform(links, one)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _wanted(paths: Mapping[str, Path], tags: Sequence[str], extra) -> dom.Wanted:
    """Which nodes carry content: some tags, the ends of paths, and those of a rule."""
    ends = [p.steps[-1].tag for p in paths.values()]
    return "all" if None in ends else lambda tag, attrs: tag in tags or tag in ends or extra(attrs)


def _is_body(attrs: dict[str, str]) -> bool:
    return attrs.get("itemprop") == "articleBody" or any(c in BODY_CLASSES for c in attrs.get("class", "").split())


def _has_text(attrs: dict[str, str]) -> bool:
    return "itemprop" in attrs or attrs.get("rel") == "tag"


def article_record(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", source_name: str = "", language: str = "",
    paths: Mapping[str, Path] | None = None, listing_title: str | None = None, listing_date: str | None = None,
    record_id: str | None = None, attachment_base: str | None = None, closed_references: bool = False,
) -> DataFrame:
    """One article a page.

    ``paths`` may set ``title``, ``date``, ``body``, ``tags`` and ``attachments``.  The title is the path's
    text, the listing's title, or the first of ``h1``, ``itemprop=headline`` and ``og:title`` with text.  The
    date is the listing's where it has an ISO day, the path's, the first dated element in page
    order, or JSON-LD.  The body is the path's element or the first by rule; other articles of the
    page stay out of it.  Attachments are document links inside the body.  Texts of elements are read
    with ``closed_references`` or without (``dom.dom_nodes``); the body's references are always closed ones.
    """
    given = dict(paths or {})
    nodes = dom.dom_nodes(
        pages, key, html, text_for=_wanted({n: p for n, p in given.items() if n != "body"}, ("h1", "time", "a"), _has_text),
        html_for=_wanted({n: p for n, p in given.items() if n == "body"}, ("article", "main", "body"), _is_body),
        closed_references=closed_references,
    )
    named = {f"__{n}": p for n, p in given.items()}
    meta = F.col("tag") == "meta"
    titles = [F.col("tag") == "h1", _is("itemprop", "headline"), meta & _is("property", "og:title")]
    dated = (F.col("tag") == "time") | _is("itemprop", "datePublished") | (meta & (_is("property", "article:published_time") | _is("name", "date")))
    bodies = [_is("itemprop", "articleBody"), F.col("tag") == "article", *[F.array_contains("classes", c) for c in BODY_CLASSES], F.col("tag") == "main"]
    around = [F.col("tag") == "main", F.col("tag") == "body"]
    tagged = _is("rel", "tag") | (meta & _is("name", "keywords"))
    suffix = F.lower(F.coalesce(_attribute("href"), F.lit("")))
    document = F.lit(False)
    for s in DOCUMENT_SUFFIXES:
        document = document | suffix.endswith(s)
    if "tags" in given:
        tagged = F.col("__tags")
    if "attachments" in given:
        document = F.col("__attachments") & _attribute("href").isNotNull()
    useful = dated | around[0] | around[1]
    for test in (*titles, *bodies, *([] if "tags" in given else [tagged]), *([] if "attachments" in given else [document])):
        useful = useful | test
    rows = reach(nodes, named, key, also=useful) if named else nodes.where(useful)
    place = F.struct(F.col("inner"), F.col("node_id"), F.col("end_id"))
    none = F.lit(None).cast("string")
    facts = rows.groupBy(key).agg(
        (_first(F.col("text"), F.col("__title")) if "title" in given else F.first(none)).alias("__title"),
        F.array(*[_first(F.coalesce(non_blank(F.col("text")), _attribute("content")), t) for t in titles]).alias("__titles"),
        (_first(F.col("text"), F.col("__date")) if "date" in given else F.first(none)).alias("__date"),
        F.min_by(_moment(), F.when(dated & _moment().isNotNull(), F.col("node_id"))).alias("__dated"),
        (F.min_by(place, F.when(F.col("__body"), F.col("node_id"))) if "body" in given else F.first(F.lit(None).cast("struct<inner: string, node_id: int, end_id: int>"))).alias("__chosen"),
        _first_rule(place, bodies).alias("__ruled"),
        _first_rule(F.col("inner"), around).alias("__around"),
        _listed(tagged, F.coalesce(non_blank(_attribute("content")), F.col("text")).alias("text")).alias("__tags"),
        _listed(document, _attribute("href").alias("href"), F.col("text").alias("text")).alias("__links"),
    )
    page = F.col(html)
    listed = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    flat = pages.select(
        key, F.col(url).alias("__url"), markup.language(page).alias("__language"), listed(listing_title).alias("__listed"), listed(listing_date).alias("__day"),
        (F.col(record_id) if record_id else none).alias("__id"),
        markup.json_ld_value(page, "datePublished").alias("__published"), markup.json_ld_value(page, "dateModified").alias("__modified"),
    )
    joined = flat.join(facts, key, "left").withColumn("__body", F.coalesce("__chosen", "__ruled"))
    day = F.when(F.col("__day").rlike(r"\d{4}-\d{2}-\d{2}"), F.col("__day"))
    date = F.coalesce(day, non_blank(F.col("__date")), F.col("__dated"), F.col("__published"), F.lit(""))
    title = F.coalesce(non_blank(F.col("__title")), non_blank(F.col("__listed")), F.get(F.filter("__titles", lambda t: ~is_blank(t)), F.lit(0)), F.lit(""))
    inner = F.coalesce(F.col("__body.inner"), F.lit(""))
    joined = joined.withColumns({"__when": date, "title": clean_inline(title), "url": urls.canonical_url(F.col("__url")), "__own": markup.article_text(inner)})
    wider = F.coalesce(markup.article_text(F.col("__around")), F.lit(""))
    text = F.coalesce(non_blank(F.col("__own")), non_blank(wider), non_blank(F.col("title")), F.col("__url"))
    aware = r"T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})$"
    when = F.when(F.col("__when").rlike(aware), source_datetime(F.col("__when"))).otherwise(publication_date(F.col("__when")))
    inside = F.filter("__links", lambda x: (x["node_id"] > F.col("__body.node_id")) & (x["node_id"] <= F.col("__body.end_id")))
    base = F.lit(attachment_base) if attachment_base else F.col("__url")
    joined = joined.withColumns({"body_text": text, "attachments": F.coalesce(_linked(base, inside), F.array().cast("array<struct<title: string, url: string>>"))})
    own_html = F.when(F.col("__own") != "", inner).otherwise(F.coalesce(non_blank(inner), non_blank(F.col("__around"))))
    return joined.select(
        key,
        F.coalesce("__id", urls.short_id(F.col("url"))).alias("record_id"),
        "title",
        F.coalesce(when, F.lit("")).alias("published_at"),
        source_datetime(F.col("__modified")).alias("source_modified_at"),
        "url",
        "body_text",
        F.coalesce(own_html, F.concat(F.lit("<p>"), _escaped(F.col("body_text")), F.lit("</p>"))).alias("body_html"),
        F.coalesce(F.array_join(unique_strings(F.transform("__tags", lambda t: F.coalesce(t["text"], F.lit("")))), "|"), F.lit("")).alias("tags"),
        "attachments",
        F.substring_index(F.coalesce(F.lit(language or None), F.col("__language"), F.lit("")), "-", 1).alias("language"),
        F.lit(source_name).alias("source_name"),
    )


def _dated(name: str, value: Column, spec: Mapping[str, Any]) -> Column:
    if name not in DATE_FIELDS:
        return value
    return source_datetime(F.coalesce(value.cast("string"), F.lit("")), str(spec.get("timezone") or "UTC"), str(spec.get("format") or ""))


def detail_records(
    pages: DataFrame, fields: Sequence[Mapping[str, Any]], key: str = "page_id", url: str = "url", html: str = "html", response: str = "response",
    listing_fields: Sequence[str] = (), constants: Mapping[str, str] | None = None, attachment_base: str | None = None,
) -> DataFrame:
    """One record a page of configured fields: key, ``listing_fields``, the fields, constants, ``url``.

    A field has a ``name`` and a ``source``: ``listing`` (``source_path`` into the page's columns), ``metadata``
    (``metadata_key``), ``response`` (``source_path`` into a JSON text column; ``value`` is raw, html_text, join or
    json), or ``selector`` with a ``path``.  A selector field takes the first element's text, its ``attribute`` or with
    ``value`` = html its content; with ``multiple`` it takes all: html gives their contents, links their titles and
    addresses (an array in ``attachments``, JSON text elsewhere), structured_tables the tables with headers, rows,
    matrix and html, anything else the texts or attributes, joined by ``separator`` if there is one.
    ``regex``, ``regex_group`` and ``default`` apply to texts; source dates become moments in UTC.
    """
    selected = [f for f in fields if str(f.get("source") or "selector") == "selector"]
    paths = {f"__hit{i}": f["path"] for i, f in enumerate(selected)}
    page = F.col(html)
    flat: dict[str, Column] = {}
    for f in fields:
        name, source = str(f["name"]), str(f.get("source") or "selector")
        if source in ("listing", "item"):
            flat[name] = path_column(pages, str(f.get("source_path") or name)).cast("string")
        elif source in ("metadata", "json_ld"):
            known = {"source_published_at": markup.published_at, "source_modified_at": markup.modified_at, "title": markup.title, "language": markup.language}
            read = known.get(str(f.get("metadata_key") or name))
            flat[name] = read(page) if read else markup.json_ld_value(page, str(f.get("metadata_key") or name))
        elif source != "selector":
            value = path_column(pages, f"{response}.{f.get('source_path') or name}").cast("string")
            mode = str(f.get("value") or "raw")
            if mode == "html_text":
                value = markup.piece_text(F.coalesce(value, F.lit("")))
            elif mode == "join":
                parts = F.transform(F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull()), clean_inline)
                value = F.coalesce(F.array_join(parts, str(f.get("separator") or "|")), value)
            flat[name] = value
    out = pages.select(key, *listing_fields, F.col(url).alias("__url"), *[v.alias(f"__flat_{n}") for n, v in flat.items()])
    if selected:
        ends = {n: p for n, p in paths.items()}
        nodes = dom.dom_nodes(
            pages, key, html, text_for=_wanted(ends, (), lambda attrs: False),
            html_for=_wanted({n: p for n, p in ends.items() if str(selected[int(n[5:])].get("value")) in ("html", "structured_tables")}, (), lambda attrs: False),
        )
        hits = reach(nodes, paths, key)
        parts = []
        for i, f in enumerate(selected):
            hit, mode = F.col(f"__hit{i}"), str(f.get("value") or "text")
            taken = content("@" + str(f["attribute"])) if f.get("attribute") else F.col("inner" if mode == "html" else "text")
            if not f.get("multiple"):
                found = _first(taken, hit)
            elif mode == "links":
                found = _listed(hit & _attribute("href").isNotNull(), _attribute("href").alias("href"), F.col("text").alias("text"))
            else:
                found = F.transform(_listed(hit, taken.alias("v")), lambda x: x["v"])
            if mode not in ("structured_tables", "table_json"):
                parts.append(found.alias(f"__field{i}"))
        if parts:
            out = out.join(hits.groupBy(key).agg(*parts), key, "left")
        for i, f in enumerate(selected):
            if str(f.get("value")) in ("structured_tables", "table_json"):
                out = out.join(_tables(pages, hits.where(F.col(f"__hit{i}") & (F.col("tag") == "table")), key, html, f"__field{i}"), key, "left")
    columns, n = [], 0
    for f in fields:
        name = str(f["name"])
        if str(f.get("source") or "selector") != "selector":
            value = F.col(f"__flat_{name}")
        else:
            value, mode = F.col(f"__field{n}"), str(f.get("value") or "text")
            n += 1
            if f.get("multiple") and mode == "links":
                value = _linked(F.lit(attachment_base) if attachment_base else F.col("__url"), F.coalesce(value, F.array().cast("array<struct<node_id: int, href: string, text: string>>")))
                columns.append((value if name == "attachments" else F.to_json(value)).alias(name))
                continue
            if f.get("multiple") and mode in ("structured_tables", "table_json", "html"):
                columns.append(F.coalesce(value, F.array()).alias(name) if mode == "html" else value.alias(name))
                continue
            if f.get("multiple"):
                value = F.array_join(value, str(f["separator"])) if f.get("separator") is not None else F.to_json(value)
        if f.get("regex"):
            value = regex_pick(value, str(f["regex"]), int(f.get("regex_group", 1)))
        if f.get("default") is not None:
            value = F.coalesce(value, F.lit(str(f["default"])))
        columns.append(_dated(name, value, f).alias(name))
    fixed = [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return out.select(key, *listing_fields, *columns, *fixed, urls.canonical_url(F.col("__url")).alias("url"))


def _tables(pages: DataFrame, tables: DataFrame, key: str, html: str, name: str) -> DataFrame:
    """The chosen tables of each page as lossless structures, numbered in page order."""
    from gleaner.operators.markup import table_structures

    chosen = tables.select(key, "node_id", "inner")
    found = table_structures(dom.table_grid(pages, key, html).join(chosen.drop("inner"), [key, "node_id"]), key, ("node_id",))
    whole = chosen.join(found, [key, "node_id"], "left")
    rows = F.sort_array(F.collect_list(F.struct("node_id", "headers", "rows", "matrix", "inner")))
    numbered = F.transform(
        rows,
        lambda t, i: F.struct(
            i.alias("table_index"), t["headers"].alias("headers"), _records(t["headers"], t["rows"]).alias("rows"), t["matrix"].alias("matrix"), t["inner"].alias("html")
        ),
    )
    return whole.groupBy(key).agg(numbered.alias(name))


def _records(headers: Column, rows: Column) -> Column:
    """Rows as maps of header and value, as far as both go."""

    def one(row: Column) -> Column:
        size = F.least(F.size(headers), F.size(row))
        return F.map_from_arrays(F.slice(headers, F.lit(1), size), F.slice(row, F.lit(1), size))

    return F.transform(rows, one)
