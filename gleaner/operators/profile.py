"""Page profiles: counters, recommended mode, pagination and selector candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import markup, urls
from gleaner.functions.binding import let, with_once
from gleaner.plans.ranking import top_per_key


def page_profile(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Counters and the recommended way to fetch a page.

    Optional columns ``rendered_text_length`` and ``xhr_candidates`` (a count) hold
    what a browser saw; without them the static page decides.
    """
    page = F.col(html)
    inputs = markup.tags(page, "input")
    links = F.filter(markup.hrefs(page), lambda h: h.rlike(markup.DOCUMENT_LINK))
    json_ld = F.filter(markup.tags(page, "script"), lambda s: s.rlike("(?i)type\\s*=\\s*[\"']application/ld\\+json[\"']"))
    captcha = F.lit(False)
    for marker in markup.CAPTCHA_MARKERS:
        captcha = captcha | F.lower(page).contains(marker)
    rendered = F.col("rendered_text_length") if "rendered_text_length" in pages.columns else F.lit(None)
    xhr = F.col("xhr_candidates") if "xhr_candidates" in pages.columns else F.lit(0)
    status = F.col("http_status") if "http_status" in pages.columns else F.lit(200)
    facts = pages.select(
        key,
        url,
        F.char_length(markup.piece_text(page)).cast("bigint").alias("static_text_length"),
        markup.tag_count(page, "table").alias("detected_tables"),
        F.size(links).cast("bigint").alias("document_links"),
        F.size(json_ld).cast("bigint").alias("json_ld_count"),
        markup.tag_count(page, "form").alias("forms"),
        F.size(F.filter(inputs, lambda i: markup.attribute(i, "type") == "password")).cast("bigint").alias("login_forms"),
        markup.tag_count(page, "script").alias("script_count"),
        markup.language(page).alias("language"),
        markup.meta_content(page, "robots").alias("robots_meta"),
        F.coalesce(captcha, F.lit(False)).alias("captcha_detected"),
        F.coalesce(rendered.cast("bigint"), F.lit(0)).alias("rendered_text_length"),
        xhr.cast("bigint").alias("xhr_candidates"),
        status.cast("int").alias("http_status"),
    )
    text, seen = F.col("static_text_length"), F.col("rendered_text_length")
    heavier = seen > F.greatest(text * 1.5, text + F.lit(500))
    shell = (text < 300) & (F.col("script_count") > 5)
    needs_script = heavier | shell
    mode = (
        F.when((F.col("document_links") > 0) & (text == 0), "DOCUMENT")
        .when(F.col("xhr_candidates") > 0, "XHR_JSON")
        .when(needs_script, "PLAYWRIGHT")
        .otherwise("HTTP")
    )
    return facts.withColumns(
        {
            "requires_javascript": needs_script,
            "recommended_fetch_mode": mode,
            "should_render": (text < 1500) | (F.col("script_count") > 8),
        }
    )


def readiness(profile: DataFrame, key: str = "page_id") -> DataFrame:
    blocked = F.col("captcha_detected") | (F.col("login_forms") > 0)
    available = F.col("http_status").between(200, 299)
    content = (F.col("static_text_length") >= 300) | (F.col("rendered_text_length") >= 300)
    status = F.when(blocked, "BLOCKED").when(~available, "FAIL").when(content, "PASS").otherwise("PARTIAL")
    reason = (
        F.when(blocked, "LOGIN_OR_CAPTCHA")
        .when(~available, "HTTP_UNAVAILABLE")
        .when(content, "PUBLIC_REPRESENTATION")
        .otherwise("INSUFFICIENT_PUBLIC_CONTENT")
    )
    return profile.select(
        key, F.col("recommended_fetch_mode").alias("transport"), status.alias("status"), reason.alias("reason")
    )


def _query_map(url: Column) -> Column:
    """Parameter to all its non-empty decoded values, in order."""
    pairs = urls.query_pairs(urls.query(url))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return let(
        F.struct(pairs.alias("pairs"), names.alias("names")),
        lambda b: F.map_from_arrays(
            b["names"],
            F.transform(
                b["names"],
                lambda n: F.transform(F.filter(b["pairs"], lambda p: p["k"] == n), lambda p: p["v"]),
            ),
        ),
    )


def pagination_candidates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``rel=next`` links (1.0) and links whose numeric query parameter differs (0.8);
    one row per target address, the first in page order."""
    page = F.col(html)
    both = F.regexp_extract_all(page, F.lit(r"(?is)<(?:a|link)(?=[\s/>])[^>]*>"), F.lit(0))
    links = pages.select(
        key, F.col(url).alias("__page"), F.posexplode(both).alias("__position", "__tag")
    ).withColumns(
        {
            "__href": markup.attribute(F.col("__tag"), "href"),
            "__next": F.coalesce(F.lower(markup.attribute(F.col("__tag"), "rel")) == "next", F.lit(False)),
            "__anchor": F.col("__tag").rlike("(?i)^<a[\\s/>]"),
        }
    )
    links = with_once(links.where(F.col("__href").isNotNull()), "url", urls.resolve(F.col("__page"), F.col("__href")))
    following = links.where("__next").select(
        key, "__position", F.lit(0).alias("__kind"), "url", F.lit("NEXT_LINK").alias("mode"), F.lit(None).cast("string").alias("parameter"), F.lit(1.0).alias("confidence")
    )
    # Links without a query are out before any map is built.
    queried = links.where(F.col("__anchor") & F.col("url").contains("?")).withColumns(
        {"here": _query_map(F.col("__page")), "there": _query_map(F.col("url"))}
    )
    entries = queried.select(key, "__position", "url", "here", F.posexplode(F.map_entries("there")).alias("__n", "e"))
    differs = ~F.col("e.value").eqNullSafe(F.try_element_at("here", F.col("e.key")))
    numeric = F.element_at("e.value", -1).rlike("^-*[0-9]+$")
    turning = entries.where(differs & numeric).select(
        key, F.struct("__position", "__n").alias("__order"), F.lit(1).alias("__kind"), "url",
        F.lit("QUERY_PARAMETER").alias("mode"), F.col("e.key").alias("parameter"), F.lit(0.8).alias("confidence"),
    )
    following = following.withColumn("__order", F.struct("__position", F.lit(0).alias("__n"))).drop("__position")
    found = following.unionByName(turning)
    return top_per_key(found, [key, "url"], [F.col("__kind"), F.col("__order")]).drop("__kind", "__order")


# Semantic date places a profile suggests, with their attribute.
SEMANTIC_DATES = (
    ("source_published_at", "time[datetime]", "datetime", r"(?is)<time(?=[^>]*\sdatetime\s*=)[^>]*>"),
    ("source_published_at", "meta[property='article:published_time']", "content", r"(?is)<meta[^>]*article:published_time[^>]*>"),
    ("source_modified_at", "meta[property='article:modified_time']", "content", r"(?is)<meta[^>]*article:modified_time[^>]*>"),
    ("source_modified_at", "[itemprop='dateModified']", "datetime", r"(?is)<[a-z][^>]*itemprop\s*=\s*[\"']dateModified[\"'][^>]*>"),
)


def metadata_candidates(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    page = F.col(html)

    def candidate(target: str, source: str, place: str, confidence: float) -> Column:
        return F.struct(
            F.lit(target).alias("target"), F.lit(source).alias("source"), F.lit(place).alias("place"), F.lit(confidence).alias("confidence")
        )

    options = [F.when(page.rlike(p), candidate(t, "selector", s, 0.9)) for t, s, _, p in SEMANTIC_DATES]
    for target, field in (("source_published_at", "datePublished"), ("source_modified_at", "dateModified")):
        has = F.array_join(markup.json_ld(page), " ").contains(f'"{field}"')
        options.append(F.when(has, candidate(target, "json_ld", f"$..{field}", 0.95)))
    return pages.select(key, F.explode(F.array_compact(F.array(*options))).alias("c")).select(key, "c.*")


def table_candidates(grid: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Tables of a page with their first row, row count and confidence."""
    order = Window.partitionBy(key).orderBy("node_id")
    tables = nodes.where("tag = 'table'").withColumn("table_index", F.row_number().over(order) - 1)
    selector = F.when(F.col("id").isNotNull(), F.concat(F.lit("#"), "id")).otherwise(
        F.concat(F.lit("table:nth-of-type("), F.col("table_index") + 1, F.lit(")"))
    )
    shape = grid.groupBy(key, "table_index").agg(
        F.min_by("own_cells", "row_index").alias("headers"), F.count(F.lit(1)).alias("row_count")
    )
    joined = tables.join(shape, [key, "table_index"], "left")
    return joined.select(
        key,
        "table_index",
        selector.alias("selector"),
        F.coalesce("headers", F.array().cast("array<string>")).alias("headers"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.when(F.size("headers") > 0, 0.95).otherwise(0.6).alias("confidence"),
    )


def repeating_candidates(
    nodes: DataFrame, key: str = "page_id", limit: int | None = None, least: int = 2, most: int | None = None
) -> DataFrame:
    """Class selectors that repeat, with how often link, title, image and date fields are
    filled over all their containers, best first.

    ``most`` and ``limit``, off by default, leave out larger groups and the less frequent
    selectors.
    """
    single = F.transform(
        F.filter("classes", lambda c: F.char_length(c) >= 3), lambda c: F.concat(F.col("tag"), F.lit("."), c)
    )
    compound = F.when(F.size("classes") > 1, F.array(F.concat(F.lit("."), F.array_join("classes", "."))))
    selectors = F.concat(F.coalesce(compound, F.array().cast("array<string>")), single)
    attrs = lambda name: F.try_element_at("attrs", F.lit(name)).isNotNull()
    roles = {
        "link": (F.col("tag") == "a") & attrs("href"),
        "heading": F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"),
        "image": (F.col("tag") == "img") & attrs("src"),
        "date": (F.col("tag") == "time") & attrs("datetime"),
    }
    marked = nodes.withColumns({f"is_{n}": c for n, c in roles.items()}).withColumn("selectors", selectors)
    # Ranges are nested or disjoint: a role lies inside when its next start is before the end.
    ahead = Window.partitionBy(key).orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
    within = {
        f"has_{n}": F.coalesce(F.min(F.when(F.col(f"is_{n}"), F.col("node_id"))).over(ahead) <= F.col("end_id"), F.lit(False))
        for n in roles
    }
    cards = marked.withColumns(within).select(
        key, "node_id", "end_id", *within, F.explode("selectors").alias("selector")
    )
    group = Window.partitionBy(key, "selector")
    ranked = cards.withColumns(
        {"rank": F.row_number().over(group.orderBy("node_id")), "count": F.count(F.lit(1)).over(group)}
    )
    first_has = {n: F.max(F.when(F.col("rank") == 1, F.col(f"has_{n}"))).alias(f"f_{n}") for n in roles}
    shares = {n: F.avg(F.col(f"has_{n}").cast("int")).alias(f"s_{n}") for n in roles}
    scored = (
        ranked.where((F.col("count") >= least) & (F.lit(True) if most is None else F.col("count") <= most))
        .groupBy(key, "selector")
        .agg(
            F.max("count").alias("count"),
            F.min(F.col("end_id") - F.col("node_id")).alias("descendant_count"),
            *first_has.values(),
            *shares.values(),
        )
    )
    # Fields come from the first container: url and title of a link, a heading, an image, a date.
    weights = {
        "link": F.col("f_link").cast("int") * 2,
        "heading": (F.col("f_heading") & ~F.col("f_link")).cast("int"),
        "image": F.col("f_image").cast("int"),
        "date": F.col("f_date").cast("int"),
    }
    total = sum(weights.values(), F.lit(0))
    filled = sum((weights[n] * F.col(f"s_{n}") for n in roles), F.lit(0.0))
    out = scored.select(
        key,
        "selector",
        "count",
        F.col("selector").startswith("a.").alias("direct_link"),
        total.cast("bigint").alias("field_count"),
        F.coalesce(F.round(F.try_divide(filled, total), 6), F.lit(0.0)).alias("field_population"),
        F.col("f_link").alias("has_link"),
        F.col("descendant_count").cast("bigint").alias("descendant_count"),
    )
    order = [
        F.col("field_population").desc(),
        F.col("has_link").desc(),
        F.least("descendant_count", F.lit(20)).desc(),
        F.col("field_count").desc(),
        F.col("count").desc(),
        F.col("direct_link"),
        F.col("selector"),
    ]
    kept = out if limit is None else top_per_key(out, [key], [F.col("count").desc(), F.col("selector")], limit)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def selector_candidates(nodes: DataFrame, candidates: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """``css``, ``xpath``, ``confidence`` and ``count`` of every repeating selector.

    The xpath asks for tag and classes of the first element that the selector matches, which may
    have more classes than it names.  Class names stand as written, not escaped.  Elements meet
    selectors as distinct class lists of a page, on one class of the selector.
    ``candidates`` are those of ``repeating_candidates``; without them nodes are read for it too.
    """
    found = repeating_candidates(nodes, key) if candidates is None else candidates
    lists = nodes.where(F.size("classes") > 0).groupBy(key, "tag", "classes").agg(F.min("node_id").alias("node_id"))
    single = F.transform(
        F.filter("classes", lambda c: F.char_length(c) >= 3),
        lambda c: F.struct(F.concat(F.col("tag"), F.lit("."), c).alias("selector"), F.col("tag").alias("tag"), F.array(c).alias("want")),
    )
    compound = F.struct(
        F.concat(F.lit("."), F.array_join("classes", ".")).alias("selector"), F.lit(None).cast("string").alias("tag"), F.col("classes").alias("want")
    )
    entries = F.when(F.size("classes") > 1, F.concat(F.array(compound), single)).otherwise(single)
    meant = (
        lists.select(key, F.explode(entries).alias("e"))
        .groupBy(key, "e.selector")
        .agg(F.min("e.tag").alias("__tag"), F.min("e.want").alias("__want"))
    )
    asked = found.select(key, "selector", "count", "field_population").join(meant, [key, "selector"])
    held = lists.select(key, "tag", "classes", "node_id", F.explode(F.array_distinct("classes")).alias("__class"))
    met = asked.withColumn("__class", F.get("__want", F.lit(0))).join(held, [key, "__class"])
    met = met.where((F.col("__tag").isNull() | (F.col("__tag") == F.col("tag"))) & (F.size(F.array_except("__want", "classes")) == 0))
    first = met.groupBy(key, "selector", "count", "field_population").agg(
        F.min_by(F.struct("tag", "classes"), "node_id").alias("e")
    )
    parts = F.transform(
        "e.classes", lambda c: F.concat(F.lit("[contains(concat(' ', normalize-space(@class), ' '), ' "), c, F.lit(" ')]"))
    )
    return first.select(
        key,
        F.col("selector").alias("css"),
        F.concat(F.lit("//"), "e.tag", F.array_join(parts, "")).alias("xpath"),
        F.least(F.lit(1.0), 0.5 + F.col("field_population") / 2).alias("confidence"),
        "count",
    )


def suggested_extractor(nodes: DataFrame, candidates: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """The best candidate of each page with selectors for its fields.

    ``fields`` holds ``name``, ``selector`` and ``attribute`` (none: the text) of ``url``, ``title``,
    ``image`` and ``source_published_at``, as far as the first container has them.  The title is the
    text of the first link, else a heading.  Pages without a candidate have no row.  Titles need the
    text of links: ``dom_nodes(..., text_for=("a",))``.
    """
    found = repeating_candidates(nodes, key) if candidates is None else candidates
    best = found.where("rank = 1").select(key, "selector", "count")
    compound = F.concat(F.lit("."), F.array_join("classes", "."))
    long_enough = F.filter("classes", lambda c: F.char_length(c) >= 3)
    own = ((F.size("classes") > 1) & (compound == F.col("selector"))) | F.array_contains(
        F.transform(long_enough, lambda c: F.concat(F.col("tag"), F.lit("."), c)), F.col("selector")
    )
    # One row a page: its best selector and that selector's first container.
    box = (
        nodes.where(F.size("classes") > 0).join(best, key).where(own)
        .groupBy(key, "selector", "count").agg(F.min_by(F.struct("node_id", "end_id"), "node_id").alias("box"))
    )
    attr = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    inner = F.col("node_id") > F.col("box.node_id")
    roles = {
        "link": (F.col("tag") == "a") & (attr("href") != ""),
        "heading": inner & (F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6") | (attr("itemprop") == "headline")),
        "image": inner & (F.col("tag") == "img") & F.try_element_at("attrs", F.lit("src")).isNotNull(),
        "date": inner
        & (((F.col("tag") == "time") & F.try_element_at("attrs", F.lit("datetime")).isNotNull()) | (attr("itemprop") == "datePublished")),
    }
    element = F.struct("tag", "classes", F.trim(F.coalesce("text", F.lit(""))).alias("text"), (attr("datetime") != "").alias("dated"))
    inside = nodes.join(box, key).where(F.col("node_id").between(F.col("box.node_id"), F.col("box.end_id")))
    firsts = inside.groupBy(key, "selector", "count").agg(
        *[F.min_by(F.when(c, element), F.when(c, F.col("node_id"))).alias(n) for n, c in roles.items()]
    )

    def field(name: str, role: str, otherwise: Column, attribute: Column) -> Column:
        classes = F.col(f"{role}.classes")
        place = F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))).otherwise(otherwise)
        return F.struct(F.lit(name).alias("name"), place.alias("selector"), attribute.alias("attribute"))

    text = F.lit(None).cast("string")
    here = {n: F.col(n).isNotNull() for n in roles}
    fields = F.array(
        F.when(here["link"], field("url", "link", F.lit("a[href]"), F.lit("href"))),
        F.when(here["link"] & (F.col("link.text") != ""), field("title", "link", F.lit("a[href]"), text)).when(
            here["heading"], field("title", "heading", F.col("heading.tag"), text)
        ),
        F.when(here["image"], field("image", "image", F.lit("img[src]"), F.lit("src"))),
        F.when(here["date"], field("source_published_at", "date", F.col("date.tag"), F.when(F.col("date.dated"), "datetime"))),
    )
    return firsts.select(
        key,
        F.col("selector").alias("container_selector"),
        F.array_compact(fields).alias("fields"),
        here["link"].alias("follow_links"),
        F.col("count").alias("candidate_count"),
    )
