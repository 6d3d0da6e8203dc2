"""URL functions built from the generic URI grammar (RFC 3986, appendix B)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions.binding import let
from feedloom.functions.text import strip, text_or_empty

# Groups: 1 scheme, 2 "//" and authority, 3 authority, 4 path, 5 query.
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# Query keys that only track the reader.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref",
)

# Schemes whose last path segment may carry parameters after a semicolon.
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel",
)


def _clean(url) -> Column:
    """URL parsers ignore leading control characters and any tab or line break."""
    return F.regexp_replace(F.translate(text_or_empty(url), "\t\r\n", ""), r"^[\x00-\x20]+", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def netloc(url) -> Column:
    """Authority as written, with port and user part; empty when there is none."""
    return _part(_clean(url), 3)


def _decode(part: Column) -> Column:
    """Percent-decode; a percent sign without two hex digits stays as it is."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _parameters(query: Column) -> Column:
    """First value of every non-tracking key, in order of first appearance, as ``key=value`` text."""
    fields = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.+"))
    pairs = F.transform(
        fields,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            _decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value"),
        ),
    )

    def first_of_key(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        return F.filter(
            pairs,
            lambda p, i: (F.array_position(keys, p["key"]) == i + 1) & ~F.lower(p["key"]).isin(*TRACKING_KEYS),
        )

    kept = let(pairs, first_of_key)
    return F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def _rebuilt(u: Column) -> Column:
    scheme, path = F.lower(_part(u, 1)), _part(u, 4)
    path = F.when(scheme.isin(*PARAM_SCHEMES), F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)
    query = F.when(
        F.contains(u, F.lit("?")),
        let(_parameters(_part(u, 5)), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("?"), p))),
    ).otherwise("")
    return F.concat(scheme, F.lit("://"), _part(u, 3), path, query)


def normalise_url(url) -> Column:
    """Comparable form of a URL: no fragment, no path parameters, no tracking keys.

    A URL whose authority has an unbalanced bracket cannot be parsed and is returned unchanged.
    """
    raw = strip(text_or_empty(url))

    def comparable(u: Column) -> Column:
        broken = F.contains(u, F.lit("[")) != F.contains(u, F.lit("]"))
        site = _part(u, 3)
        broken = broken & (F.contains(site, F.lit("[")) != F.contains(site, F.lit("]")))
        return F.when(broken, raw).otherwise(_rebuilt(u))

    return let(_clean(raw), comparable)


def absolute_link(link, host: str = "https://www.linkedin.com") -> Column:
    """Prefix site-relative links with the host."""
    link = F.col(link) if isinstance(link, str) else link
    return F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(host), link)).otherwise(link)
