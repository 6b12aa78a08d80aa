"""URL columns: split, resolve, canonical form, policy checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.binding import let

# Query parameters that never carry identity.
TRACKING_PARAMETERS = ("utm", "gclid", "fbclid", "yclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port."""
    bare = F.regexp_replace(netloc(url), "^.*@", "")
    return F.lower(F.regexp_replace(bare, ":[0-9]*$", ""))


def port(url: Column) -> Column:
    given = F.regexp_extract(netloc(url), ":([0-9]+)$", 1)
    standard = F.when(scheme(url) == "https", F.lit(443)).otherwise(F.lit(80))
    return F.when(given != "", given.try_cast("int")).otherwise(standard)


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(text: Column) -> Column:
    """Decoded ``(k, v)`` structs of a query text in order; blank values are kept."""
    raw = F.filter(F.split(text, "&"), lambda part: part != "")
    return F.transform(
        raw,
        lambda part: F.struct(
            _decode(F.substring_index(part, "=", 1)).alias("k"),
            _decode(F.when(part.contains("="), F.regexp_replace(part, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )


def split_url(url: Column) -> Column:
    """Struct of the lower-case scheme, the place, the path and the page's folder root."""
    return F.struct(
        url.alias("url"), scheme(url).alias("scheme"), netloc(url).alias("place"), path(url).alias("path"), query(url).alias("query")
    )


def canonical_url(url: Column, drop_parameters: Sequence[str] = ()) -> Column:
    return let(split_url(url), lambda parts: _canonical(parts, drop_parameters))


def _canonical(parts: Column, drop_parameters: Sequence[str]) -> Column:
    dropped = [p.lower() for p in drop_parameters] + list(TRACKING_PARAMETERS)
    kept = F.filter(
        query_pairs(parts["query"]),
        lambda pair: ~F.lower(pair["k"]).isin(*dropped) & ~F.lower(pair["k"]).startswith(TRACKING_PREFIX),
    )
    encoded = F.array_join(
        F.transform(F.array_sort(kept), lambda pair: F.concat(_encode(pair["k"]), F.lit("="), _encode(pair["v"]))),
        "&",
    )
    tidy = F.regexp_replace(F.regexp_replace(parts["path"], "/{2,}", "/"), "/+$", "")
    rooted = F.when(parts["place"] != "", F.regexp_replace(tidy, "^([^/])", "/$1")).otherwise(tidy)
    return F.concat(
        F.regexp_replace(parts["scheme"], "^(.+)$", "$1:"),
        F.regexp_replace(F.lower(parts["place"]), "^(.+)$", "//$1"),
        rooted,
        F.regexp_replace(encoded, "^(.+)$", "?$1"),
    )


def _without_dot_segments(full_path: Column) -> Column:
    folded = F.aggregate(
        F.split(full_path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))),
    )
    joined = F.array_join(folded, "/")
    closed = F.when(full_path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(full_path.rlike(r"/\.\.?(?:/|$)"), closed).otherwise(full_path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` found on page ``base``."""
    return let(F.struct(base.alias("base"), href.alias("href")), lambda pair: _resolve(pair["base"], pair["href"]))


def _resolve(base: Column, href: Column) -> Column:
    no_fragment = F.regexp_replace(base, "#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
    raw = F.when(href.startswith("/"), path(href)).when(folder == "", F.concat(F.lit("/"), path(href)))
    raw = raw.otherwise(F.concat(folder, path(href)))
    return (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(no_fragment, r"\?.*$", ""), href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(root, let(raw, _without_dot_segments), F.regexp_extract(href, r"^[^?#]*([?#].*)$", 1)))
    )


def short_id(url: Column) -> Column:
    """Stable record id of a URL: the first 20 hex digits of its sha256."""
    return F.substring(F.sha2(url, 256), 1, 20)


def within_domains(host_column: Column, domains: Sequence[str]) -> Column:
    """True for a listed domain and any of its subdomains."""
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host_column == domain) | host_column.endswith(f".{domain}")
    return hit


def public_ipv4(address: Column) -> Column:
    """False for private, loopback, link-local, shared, reserved and multicast ranges."""
    parts = F.split(address, "[.]")
    octets = [F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(4)]
    a, b, c, _ = octets
    valid = (F.size(parts) == 4)
    for octet in octets:
        valid = valid & F.coalesce(octet.between(0, 255), F.lit(False))
    special = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(valid & ~special, F.lit(False))


def file_suffix(url: Column) -> Column:
    """Lower-case suffix of the last path part, with its dot; '' if none."""
    return F.lower(F.regexp_extract(path(url), r"[^/](\.[^./]+)$", 1))
