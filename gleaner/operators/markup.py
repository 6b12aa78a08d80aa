"""Records from markup: lists, tables, card clusters, articles, field candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import markup, urls
from gleaner.functions.binding import let
from gleaner.functions.numbers import parse_decimal
from gleaner.functions.records import path_column
from gleaner.functions.text import clean_inline, field_name
from gleaner.plans.ranking import running_total, top_per_key

DATE_LIKE = r"\b\d{2}[./-]\d{2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
RATE_LIKE = r"(?i)\d+[.,]?\d*\s*%|\b\d+[.,]\d{2,}\b|\b(?:BYN|RUB|USD|EUR|PLN|BYR)\b"
# Fixed value: a class name that makes part of a signature.
CLASS_TOKEN = r"^[A-Za-z_][\w-]*$"
CHROME_TAGS = ("header", "footer", "nav")


def matches(
    tag: str | None = None,
    id: str | None = None,
    classes: Sequence[str] = (),
    attributes: Mapping[str, str | None] | None = None,
) -> Column:
    """Simple selector over ``dom_nodes`` rows; an attribute value of None means "present"."""
    test = F.lit(True)
    if tag:
        test = test & (F.col("tag") == tag)
    if id:
        test = test & F.col("id").eqNullSafe(F.lit(id))
    for name in classes:
        test = test & F.array_contains("classes", name)
    for name, value in (attributes or {}).items():
        found = F.try_element_at("attrs", F.lit(name))
        test = test & (found.isNotNull() if value is None else found.eqNullSafe(F.lit(value)))
    return test


def node_value(name: str | None = None) -> Column:
    return F.try_element_at("attrs", F.lit(name)) if name else F.col("text")


def page_summary(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Text, links, title and language of each page."""
    page = F.col(html)
    return pages.select(
        key,
        markup.piece_text(page).alias("text"),
        markup.hrefs(page).alias("links"),
        markup.title(page).alias("title"),
        markup.language(page).alias("language"),
    )


def select_elements(
    nodes: DataFrame, where: Column, value: Column, single: bool = False, key: str = "page_id", shown_chars: int | None = None
) -> DataFrame:
    """Values of matching nodes in page order, with the value as evidence; ``single`` keeps the first.

    ``shown_chars`` shortens the evidence, never the value.
    """
    found = nodes.where(where).select(key, "node_id", value.alias("value"))
    shown = (F.col("value") if shown_chars is None else F.substring(F.col("value"), 1, shown_chars)).alias("evidence")
    if single:
        counted = found.groupBy(key).agg(F.min_by("value", "node_id").alias("value"), F.count(F.lit(1)).alias("count"))
        return counted.select(key, "value", "count", shown)
    return found.select(key, "node_id", "value", shown)


def select_xpath(pages: DataFrame, xml: str, expression: str, key: str = "page_id") -> DataFrame:
    """Texts an XPath finds in well-formed XML."""
    return pages.select(key, F.posexplode(F.xpath(F.col(xml), F.lit(expression))).alias("position", "value"))


def _inside(key: str, hit: Column, node: str = "node_id") -> Column:
    """True when an earlier matching node's range still covers this node.

    A page is one parsed document, so this window never spans more than one input row.
    """
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(hit, F.col("end_id"))).over(order) >= F.col(node), F.lit(False))


def content_links(nodes: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Content links only: no placeholders, no utility paths, nothing in page chrome;
    when the page has links inside ``main`` only those count."""
    crumb = F.exists("classes", lambda c: F.lower(c).contains("breadcrumb")) | F.lower(
        F.coalesce("id", F.lit(""))
    ).contains("breadcrumb")
    chrome = F.col("tag").isin(*CHROME_TAGS) | crumb
    link = (F.col("tag") == "a") & F.try_element_at("attrs", F.lit("href")).isNotNull()
    wanted = nodes.where(chrome | link | (F.col("tag") == "main"))
    flags = wanted.withColumns({"in_chrome": _inside(key, chrome), "in_main": _inside(key, F.col("tag") == "main")})
    page = Window.partitionBy(key)
    flags = flags.withColumn("any_main", F.max(link & F.col("in_main")).over(page))
    href = F.trim(F.try_element_at("attrs", F.lit("href")))
    links = flags.where(link & ~F.col("in_chrome") & (~F.col("any_main") | F.col("in_main"))).select(
        key, "node_id", href.alias("href"), F.col("text").alias("title")
    )
    shown = links.where(
        (F.col("href") != "")
        & ~F.col("href").startswith("#")
        & ~F.col("href").rlike("(?i)^(?:javascript|mailto|tel):")
    )
    trimmed = F.lower(F.regexp_replace(urls.path(F.col("href")), "/+$", ""))
    shown = shown.where(~trimmed.isin("", "/search"))
    return shown.join(pages.select(key, F.col(url).alias("__page")), key).select(
        key, "node_id", "title", urls.resolve(F.col("__page"), F.col("href")).alias("url")
    )


def repeating_list(
    nodes: DataFrame,
    container: Column,
    fields: Mapping[str, tuple[Column | None, Column]],
    defaults: Mapping[str, str] | None = None,
    key: str = "page_id",
) -> DataFrame:
    """One row per container; each field is its first matching descendant.

    ``fields`` maps a name to ``(selector, value)``; a selector of None means the
    container itself.  Every interesting node is sent to its ancestors and folded
    there, so no container×node pairs arise and map-side aggregation applies.
    """
    flags = {"__container": container}
    for i, (where, value) in enumerate(fields.values()):
        flags[f"__hit{i}"] = container if where is None else where
        flags[f"__value{i}"] = value
    marked = nodes.withColumns(flags)
    useful = F.col("__container")
    for i in range(len(fields)):
        useful = useful | F.col(f"__hit{i}")
    spread = marked.where(useful).withColumn("__anchor", F.explode("path"))
    own = F.col("__anchor") == F.col("node_id")
    parts = [F.bool_or(F.col("__container") & own).alias("__is_container")]
    for i, (name, (where, _)) in enumerate(fields.items()):
        hit = F.col(f"__hit{i}") & (own if where is None else ~own)
        parts.append(F.min_by(F.col(f"__value{i}"), F.when(hit, F.col("node_id"))).alias(name))
    rows = spread.groupBy(key, "__anchor").agg(*parts).where("__is_container")
    values = [F.coalesce(F.col(n), F.lit((defaults or {}).get(n))).alias(n) for n in fields]
    return rows.select(key, F.col("__anchor").alias("node_id"), *values)


def rss_items(pages: DataFrame, xml: str = "html", key: str = "page_id") -> DataFrame:
    """Feed items with url, title and guid; only for feeds without HTML anchors.
    An empty ``<link/>`` followed by the address takes that address."""
    text = F.col(xml)
    feeds = pages.where(text.rlike("(?i)<item[\\s>]") & ~text.rlike("(?is)<a\\s[^>]*href"))
    bodies = F.regexp_extract_all(text, F.lit("(?is)<item(?:\\s[^>]*)?>(.*?)</item>"), F.lit(1))
    items = feeds.select(key, F.posexplode(bodies).alias("position", "item"))

    def element(name: str) -> Column:
        raw = F.regexp_extract(F.col("item"), rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        plain = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        return F.trim(markup.unescape(F.regexp_replace(plain, "<[^>]+>", " ")))

    tail = F.regexp_extract(F.col("item"), r"(?is)<link\s*/>\s*(https?://[^<\s]+)", 1)
    link = F.when(element("link") != "", element("link")).otherwise(tail)
    guid = element("guid")
    return items.select(
        key, "position", link.alias("url"), element("title").alias("title"), F.when(guid != "", guid).alias("record_id")
    ).where(F.col("url") != "")


def dedupe_headers(headers: Column) -> Column:
    """Blank headers become ``column_n``; repeats get ``_2``, ``_3`` in order."""
    bases = F.transform(
        headers,
        lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(h)),
    )

    def numbered(base: Column, i: Column, all_bases: Column) -> Column:
        seen = F.size(F.filter(F.slice(all_bases, F.lit(1), i + 1), lambda b: b == base))
        return F.when(seen == 1, base).otherwise(F.concat(base, F.lit("_"), seen.cast("string")))

    return let(bases, lambda all_bases: F.transform(all_bases, lambda base, i: numbered(base, i, all_bases)))


def table_rows(grid: DataFrame, key: str = "page_id") -> DataFrame:
    """Non-blank table rows, numbered from 0 within their table."""
    rows = grid.where(F.exists("cells", lambda c: c != ""))
    # A table is part of one page, which was one input row of the parser.
    order = Window.partitionBy(key, "table_index").orderBy("row_index")
    return rows.withColumn("position", F.row_number().over(order) - 1)


def table_records(
    grid: DataFrame,
    pages: DataFrame | None = None,
    header_row: int = 0,
    table_index: int | None = 0,
    selector: str = "table",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Data rows of one table per page as ``map<header, value>`` with a structural identity.

    An index beyond the tables of a page falls back to its first table; an index of None
    takes ``grid`` as chosen already (``structure.pick_table``).
    """
    if table_index is not None:
        page = Window.partitionBy(key)
        numbered = grid.withColumn("__last", F.max("table_index").over(page)) if table_index else grid.withColumn("__last", F.lit(0))
        chosen = F.when(F.col("__last") >= table_index, F.lit(table_index)).otherwise(F.lit(0))
        grid = numbered.where(F.col("table_index") == chosen).drop("__last")
    rows = table_rows(grid, key)
    table = Window.partitionBy(key, "table_index")
    header = F.max(F.when(F.col("position") == header_row, F.col("cells"))).over(table)
    data = rows.withColumn("__head", header).where(F.col("position") > header_row)
    headers = dedupe_headers(F.col("__head"))
    size = F.least(F.size("__head"), F.size("cells"))
    out = data.select(
        key,
        (F.col("position") - header_row - 1).alias("row_index"),
        F.concat(F.lit(f"{selector}:"), F.col("table_index")).alias("table_id"),
        F.map_from_arrays(F.slice(headers, F.lit(1), size), F.slice("cells", F.lit(1), size)).alias("record"),
    )
    if pages is None:
        return out
    return out.join(pages.select(key, F.col(url).alias("page_url")), key)


def normalized_record(record: Column) -> Column:
    """Adds structural field names beside the original headers."""
    renamed = F.map_from_entries(
        F.transform(F.map_entries(record), lambda e: F.struct(field_name(e["key"]).alias("k"), e["value"].alias("v")))
    )
    fresh = F.map_filter(renamed, lambda k, _: (k != "") & ~F.map_contains_key(record, k))
    return F.map_concat(record, fresh)


def table_structures(grid: DataFrame, key: str = "page_id", also: Sequence[str] = ()) -> DataFrame:
    """Lossless tables: headers (last ``thead`` row, else the first row) and data rows; a table
    of blank cells has neither.  ``also`` names columns that are the same in a table's rows."""
    clean = {c: F.transform(c, clean_inline) for c in ("cells", "own_cells")}
    grid = grid.withColumns(clean)
    rows = table_rows(grid, key)
    last = grid.where("in_head").groupBy(key, "table_index").agg(
        F.max_by("own_cells", "row_index").alias("head"), F.count(F.lit(1)).alias("head_rows")
    )
    blank = grid.groupBy(key, "table_index", *also).agg(F.count(F.lit(1)).alias("all_rows"))
    matrix = rows.groupBy(key, "table_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "cells"))), lambda r: r["cells"]).alias("matrix")
    )
    joined = blank.join(matrix, [key, "table_index"], "left").join(last, [key, "table_index"], "left")
    nothing = F.array().cast("array<array<string>>")
    joined = joined.withColumn("matrix", F.coalesce("matrix", nothing))
    header = dedupe_headers(F.coalesce("head", F.get("matrix", F.lit(0)), F.array().cast("array<string>")))
    start = F.coalesce(F.col("head_rows"), F.lit(1)).cast("int")
    return joined.select(
        key, "table_index", *also, header.alias("headers"), F.slice("matrix", start + 1, F.size("matrix")).alias("rows"), "matrix"
    )


def class_signature() -> Column:
    """``tag.class.class`` of a node's well-formed classes in order; null without any."""
    valid = F.array_sort(F.array_distinct(F.filter("classes", lambda c: c.rlike(CLASS_TOKEN))))
    return F.when(F.size(valid) > 0, F.concat(F.col("tag"), F.lit("."), F.array_join(valid, ".")))


def card_clusters(
    nodes: DataFrame, key: str = "page_id", limit: int | None = None, least: int = 3, most: int | None = None
) -> DataFrame:
    """Repeating containers by ``tag.classes`` signature, scored over all their items and ranked per page.

    A container repeats from ``least`` items on.  ``most`` and ``limit``, off by default, leave
    out larger clusters and lower ranks; ``card_clusters`` without them lists what they exclude.
    ``exact`` holds the averages before rounding.
    """
    signature = class_signature()
    link = (F.col("tag") == "a") & F.try_element_at("attrs", F.lit("href")).isNotNull()
    marked = nodes.withColumns({"signature": signature, "__link": link}).where(F.col("signature").isNotNull() | F.col("__link"))
    ahead = Window.partitionBy(key).orderBy("node_id").rowsBetween(1, Window.unboundedFollowing)
    next_link = F.min(F.when(F.col("__link"), F.col("node_id"))).over(ahead)
    marked = marked.withColumn("has_link", F.coalesce(next_link <= F.col("end_id"), F.lit(False)))
    signal = F.col("text").rlike(DATE_LIKE) | F.col("text").rlike(RATE_LIKE)
    scored = (
        marked.where(F.col("signature").isNotNull())
        .groupBy(key, "signature")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(F.char_length("text")).alias("average"),
            F.avg(F.col("has_link").cast("int")).alias("link"),
            F.avg(signal.cast("int")).alias("signal"),
            F.avg(F.col("end_id") - F.col("node_id")).alias("descendants"),
            F.min("node_id").alias("first_node"),
        )
        .where(F.col("count") >= least)
        .where("average >= 25")
    )
    if most is not None:
        scored = scored.where(F.col("count") <= most)
    result = scored.select(
        key,
        F.col("signature").alias("selector"),
        "count",
        F.bround("average", 1).alias("avg_text_length"),
        F.bround("link", 3).alias("link_fraction"),
        F.bround("signal", 3).alias("signal_fraction"),
        F.bround("descendants", 1).alias("descendant_count"),
        F.struct("average", "link", "signal").alias("exact"),
        F.least(F.bround("average", 0), F.lit(2000.0)).alias("__text"),
        "first_node",
    )
    order = [F.col(c).desc() for c in ("signal_fraction", "link_fraction", "__text", "count")] + [F.col("first_node")]
    ranked = result.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return kept.drop("__text", "first_node")


def cluster_passes(exact: bool = False) -> Column:
    """Structural bar for automatic selection: link cards or signal-rich panels.

    The shown, rounded figures meet the bar; with ``exact`` those before rounding do.
    """
    shown = ("avg_text_length", "link_fraction", "signal_fraction")
    text, link, signal = (F.col(c) for c in (("exact.average", "exact.link", "exact.signal") if exact else shown))
    return ((text >= 40) & (link >= 0.2)) | ((text >= 60) & (signal >= 0.3))


def cluster_report(nodes: DataFrame, key: str = "page_id", shown: int | None = None) -> DataFrame:
    """Pages whose clusters all fail the bar, with their candidates, best first, to pin by hand."""
    named = F.lit(True) if shown is None else F.col("rank") <= shown
    found = card_clusters(nodes, key).withColumn("passes", cluster_passes())
    pages = found.groupBy(key).agg(
        F.bool_or("passes").alias("selected"),
        # Names of one page's clusters.
        F.array_sort(F.collect_list(F.when(named, F.struct("rank", "selector")))).alias("top"),
    )
    names = F.array_join(F.transform("top", lambda t: t["selector"]), ", ")
    return pages.where(~F.col("selected")).select(key, F.lit("CARD_CLUSTER_NOT_FOUND").alias("code"), names.alias("candidates"))


def auto_cards(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Cards of the best passing cluster of every page with default url, title and text."""
    best = top_per_key(card_clusters(nodes, key).where(cluster_passes()), [key], [F.col("rank")])
    signature = class_signature()
    chosen = nodes.join(best.select(key, F.col("selector").alias("__selector")), key)
    link = matches("a", attributes={"href": None})
    return repeating_list(
        chosen,
        signature == F.col("__selector"),
        {"url": (link, node_value("href")), "title": (matches("a"), node_value()), "text": (None, node_value())},
        key=key,
    )


def finish_cards(cards: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url", partitions: int | None = None) -> DataFrame:
    """Row index across pages, page url, placeholder links dropped, equal cards kept once."""
    sizes = cards.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    # Only the per-page sizes are ranged and pinned, not the cards.
    offsets = running_total(sizes, [key], F.col("__size"), "__until", partitions)
    offsets = offsets.select(key, (F.col("__until") - F.col("__size")).alias("__before"))
    local = F.row_number().over(Window.partitionBy(key).orderBy("node_id")) - 1
    placed = cards.withColumn("__local", local).join(offsets, key)
    link = F.trim(F.coalesce("url", F.lit("")))
    empty = link.isin("#", "") | link.startswith("javascript:") | link.startswith("void(")
    rows = placed.join(pages.select(key, F.col(url).alias("page_url")), key).withColumns(
        {"row_index": F.col("__before") + F.col("__local"), "url": F.when(~empty, F.col("url"))}
    )
    same = [F.coalesce(c, F.lit("")) for c in ("url", "title", "text")]
    return top_per_key(rows, same, [F.col("row_index")]).drop("__local", "__before")


def document_record(pages: DataFrame, key: str = "page_id", url: str = "url", title: str | None = None) -> DataFrame:
    """Records of pages whose address is a document file."""
    direct = pages.where(urls.file_suffix(F.col(url)).isin(".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip"))
    name = F.regexp_extract(urls.path(F.col(url)), "([^/]*)$", 1)
    shown = clean_inline(F.coalesce(F.col(title), name) if title else name)
    canonical = urls.canonical_url(F.col(url))
    return direct.select(
        key, urls.short_id(canonical).alias("record_id"), shown.alias("title"), canonical.alias("url"), shown.alias("body_text"),
        F.array(F.struct(shown.alias("title"), canonical.alias("url"))).alias("attachments"),
    )


def _shape(kind: T.DataType) -> str:
    """Type of a plain column, in the words of JSON."""
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.MapType, T.StructType)):
        return "object"
    if isinstance(kind, T.NumericType):
        return "number"
    return "boolean" if isinstance(kind, T.BooleanType) else "string"


def _fits(value: Column, shape: Column, expected: str) -> Column:
    if expected in ("number", "decimal"):
        return (shape == "number") | parse_decimal(value).isNotNull()
    wanted = {"string": "string", "text": "string", "object": "object", "json": "object", "array": "array"}.get(expected)
    return F.lit(True) if wanted is None else shape == wanted


def schema_first(
    df: DataFrame,
    candidates: Mapping[str, Sequence[Mapping[str, Any]]],
    selection: str = "first_valid",
    mode: str = "AUTO",
    pinned: Mapping[str, str] | None = None,
    seq: str = "_seq",
) -> tuple[DataFrame, DataFrame]:
    """Target columns from ordered candidates: ``(records, errors)``.

    A candidate has ``path`` (or a ready ``column``), or a constant ``value``, and
    optional ``id``, ``valueType`` (string, number, object, array), ``multiple``, ``required``,
    ``minCoverage``.  ``type``, a column, names the type of a ready column where it differs by row.
    Lists and objects are given as JSON text.  ``candidates.from_pages`` prepares candidates of
    elements and JSON-LD.
    """
    columns: dict[str, Column] = {}
    evidence: list[Column] = []
    problems: list[Column] = []
    working = df
    for target, options in candidates.items():
        entries = []
        for position, option in enumerate(options):
            if "column" in option:
                raw, pointer = option["column"], str(option.get("path") or "")
            elif option.get("kind") == "constant":
                raw, pointer = F.lit(option.get("value")), "constant"
            else:
                raw, pointer = path_column(df, str(option.get("path") or "")), str(option.get("path") or "")
            known = df.select(raw.alias("v")).schema["v"].dataType
            nested = isinstance(known, (T.ArrayType, T.MapType, T.StructType))
            value = F.to_json(raw) if nested else raw.cast("string")
            expected = str(option.get("valueType") or option.get("value_type") or "")
            shape = option["type"] if "type" in option else F.lit(_shape(known))
            if option.get("multiple"):
                # Lists pass whatever their items are; an empty one is no value.
                filled, fits = value.isNotNull() & (value != "[]"), shape == "array"
            else:
                filled, fits = value.isNotNull() & (value != ""), _fits(value, shape, expected)
            required = bool(option.get("required", True))
            minimum = float(option.get("minCoverage", option.get("min_coverage", 1.0 if required else 0.0)) or 0.0)
            coverage = F.when(filled, F.lit(1.0)).otherwise(F.lit(0.0))
            entries.append(
                F.struct(
                    F.lit(str(option.get("id") or f"{target}:{position}")).alias("id"),
                    F.lit(position).alias("position"),
                    F.lit(str(option.get("kind") or "path")).alias("kind"),
                    F.lit(pointer).alias("pointer"),
                    value.alias("value"),
                    coverage.alias("coverage"),
                    F.coalesce(filled & fits & (coverage >= minimum), F.lit(False)).alias("passed"),
                )
            )
        choice, spread = f"__accepted_{target}", f"__values_{target}"
        accepted = F.filter(F.array(*entries), lambda c: c["passed"])
        pin = (pinned or {}).get(target)
        if mode.upper() in ("MANUAL", "ASSISTED") and pin:
            accepted = F.filter(F.array(*entries), lambda c: c["passed"] & (c["id"] == pin))
        working = working.withColumn(choice, accepted)
        picked = F.get(choice, F.lit(0))
        if selection == "best_coverage":
            top = F.array_max(F.transform(choice, lambda c: c["coverage"]))
            picked = F.get(F.filter(choice, lambda c: c["coverage"] == top), F.lit(0))
        elif selection == "merge_non_conflicting":
            working = working.withColumn(spread, F.size(F.array_distinct(F.transform(choice, lambda c: c["value"]))))
            picked = F.when(F.col(spread) == 1, picked)
            problems.append(
                F.when(F.col(spread) > 1, F.struct(F.lit(target).alias("field"), F.lit("CANDIDATE_CONFLICT").alias("code")))
            )
        working = working.withColumn(f"__picked_{target}", picked)
        chosen = F.col(f"__picked_{target}")
        columns[target] = chosen["value"]
        evidence.append(F.struct(F.lit(target).alias("k"), chosen.alias("v")))
        if any(bool(o.get("required")) for o in options):
            problems.append(
                F.when(chosen.isNull(), F.struct(F.lit(target).alias("field"), F.lit("FIELD_CANDIDATES_EXHAUSTED").alias("code")))
            )
    kept = F.filter(F.array(*evidence), lambda e: e["v"].isNotNull())
    records = working.select(
        seq, *[v.alias(k) for k, v in columns.items()], F.map_from_entries(kept).alias("_evidence")
    )
    if not problems:
        return records, df.select(seq, F.lit("").alias("field"), F.lit("").alias("code")).where(F.lit(False))
    errors = working.select(seq, F.explode(F.array_compact(F.array(*problems))).alias("e")).select(seq, "e.field", "e.code")
    return records, errors
