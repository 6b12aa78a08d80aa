"""Flat facts of a page with native regular expressions, no Python on the path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.binding import let
from gleaner.functions.text import clean_article, clean_inline, strip

# The named character references that pages use most.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&amp;", "&"),
)
# Markers of a challenge page, and readable document types.
CAPTCHA_MARKERS = ("captcha", "recaptcha", "hcaptcha", "я не робот")
DOCUMENT_LINK = r"(?i)\.(?:pdf|docx|xlsx|csv)$"
ATTACHMENT_LINK = r"(?i)\.(?:pdf|docx?|xlsx?|zip)$"

_INERT = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
_TAG = r"<[^>]+>"


def unescape(value: Column) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, value)


def attribute(tag: Column, name: str) -> Column:
    """Attribute of one start tag; null when absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(rf"(?is)\s{name}\s*="), unescape(value))


def tags(html: Column, name: str) -> Column:
    """All start tags of one element, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>])[^>]*>"), F.lit(0))


def tag_count(html: Column, name: str) -> Column:
    return F.size(tags(html, name)).cast("bigint")


def hrefs(html: Column) -> Column:
    """``href`` of every anchor that has one."""
    return F.filter(F.transform(tags(html, "a"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def without_inert(html: Column) -> Column:
    return F.regexp_replace(html, _INERT, " ")


def element_text(inner: Column) -> Column:
    """Inline text of an element's markup."""
    bare = F.regexp_replace(F.regexp_replace(without_inert(inner), "(?s)<!--.*?-->", " "), _TAG, " ")
    return clean_inline(unescape(bare))


def piece_text(html: Column) -> Column:
    """All text pieces, each trimmed, joined by one blank."""
    bare = F.regexp_replace(without_inert(html), "(?s)<!--.*?-->", "<!>")
    pieces = F.transform(F.split(bare, "<[^>]+>"), lambda piece: strip(unescape(piece)))
    return F.array_join(F.filter(pieces, lambda piece: piece != ""), " ")


def article_text(inner: Column) -> Column:
    """Each text piece is a line; blank lines separate the lines."""
    bare = F.regexp_replace(F.regexp_replace(without_inert(inner), "(?s)<!--.*?-->", "\n"), _TAG, "\n")
    return clean_article(unescape(bare))


def inner_html(html: Column, name: str, greedy: bool = False) -> Column:
    """Markup inside the first element of a kind; null when missing or empty."""
    body = ".*" if greedy else ".*?"
    found = F.regexp_extract(html, rf"(?is)<{name}(?=[\s/>])[^>]*>({body})</{name}\s*>", 1)
    return let(found, lambda inner: F.when(inner != "", inner))


def title(html: Column) -> Column:
    return F.coalesce(F.trim(unescape(inner_html(html, "title"))), F.lit(""))


def language(html: Column) -> Column:
    return F.get(F.transform(tags(html, "html"), lambda t: attribute(t, "lang")), F.lit(0))


def visible_length(html: Column) -> Column:
    """Characters left after markup, script and style are gone."""
    bare = F.regexp_replace(without_inert(html), _TAG, " ")
    return F.char_length(clean_inline(bare)).cast("bigint")


def shell_score(html: Column) -> Column:
    """Share of the page inside script and style, three decimals."""
    blocks = F.regexp_extract_all(html, F.lit(_INERT), F.lit(0))
    inert = F.aggregate(F.transform(blocks, F.char_length), F.lit(0), lambda total, n: total + n)
    return F.round(inert / F.greatest(F.char_length(html), F.lit(1)), 3)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def json_ld(html: Column) -> Column:
    """Bodies of readable JSON-LD scripts, in page order."""
    bodies = F.regexp_extract_all(
        html, F.lit(r"(?is)<script(?=[^>]*type\s*=\s*[\"']application/ld\+json[\"'])[^>]*>(.*?)</script>"), F.lit(1)
    )
    return F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())


def json_ld_value(html: Column, name: str) -> Column:
    """A top-level field wins over nested ones; the first script that has it decides."""

    def found(body: Column) -> Column:
        top = F.get_json_object(body, f"$.{name}")
        nested = F.regexp_extract(body, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)+)"', 1)
        return F.coalesce(F.when(top != "", top), nested)

    return _first(F.transform(json_ld(html), found))


def _tag_value(html: Column, opening: str) -> Column:
    """``datetime``, ``content`` or the text after the first tag that matches."""

    def read(tag: Column) -> Column:
        text = F.regexp_extract(html, rf"(?is){opening}([^<]*)", 1)
        return F.coalesce(
            F.when(attribute(tag, "datetime") != "", attribute(tag, "datetime")),
            F.when(attribute(tag, "content") != "", attribute(tag, "content")),
            F.when(clean_inline(text) != "", clean_inline(text)),
        )

    return let(F.regexp_extract(html, rf"(?is){opening}", 0), lambda tag: F.when(tag != "", read(tag)))


# Places where pages keep their dates, in order of preference.
PUBLISHED_TAGS = (
    r"<time(?=[^>]*\sdatetime\s*=)[^>]*>",
    r"<[a-z][^>]*\sitemprop\s*=\s*[\"']datePublished[\"'][^>]*>",
    r"<meta[^>]*\sproperty\s*=\s*[\"']article:published_time[\"'][^>]*>",
)
MODIFIED_TAGS = (
    r"<[a-z][^>]*\sitemprop\s*=\s*[\"']dateModified[\"'][^>]*>",
    r"<meta[^>]*\sproperty\s*=\s*[\"']article:modified_time[\"'][^>]*>",
)


def published_at(html: Column) -> Column:
    return F.coalesce(json_ld_value(html, "datePublished"), *[_tag_value(html, t) for t in PUBLISHED_TAGS])


def modified_at(html: Column) -> Column:
    return F.coalesce(json_ld_value(html, "dateModified"), *[_tag_value(html, t) for t in MODIFIED_TAGS])


def meta_content(html: Column, name: str) -> Column:
    pattern = rf"(?is)<meta(?=[^>]*\sname\s*=\s*[\"']{name}[\"'])[^>]*>"
    return attribute(F.regexp_extract(html, pattern, 0), "content")
