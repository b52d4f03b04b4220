"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries of top-level domains.
COUNTRIES = {
    "uk": "United Kingdom",
    "de": "Germany",
    "fr": "France",
    "jp": "Japan",
    "cn": "China",
    "au": "Australia",
    "ca": "Canada",
    "in": "India",
    "br": "Brazil",
    "ru": "Russia",
}


def host(url: Column) -> Column:
    """Host without user info and port, lower-cased."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def netloc(url: Column) -> Column:
    """Host with user info and port, as written."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column, *, keep_fragment_with_query: bool = False) -> Column:
    """Lower-cased and trimmed, query sorted, fragment removed.

    ``keep_fragment_with_query`` keeps the fragment where there is a query.
    """
    x = F.lower(F.trim(url))
    base, query, fragment = (F.regexp_extract(x, r"^([^?#]*)(?:\?([^#]*))?(#.*)?$", i) for i in (1, 2, 3))
    tail = fragment if keep_fragment_with_query else F.lit("")
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"), tail))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def resolve(base: Column, link: Column) -> Column:
    """A link against its page: absolute, scheme-relative, rooted, query, fragment and relative links with dot segments."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.concat(root, path(base)), "([^/])/[^/]*$", "$1/")
    folder = F.when(path(base) == "", F.concat(root, F.lit("/"))).otherwise(folder)
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, _dots(link)))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link == "", base)
        .otherwise(F.concat(root, _dots(F.concat(F.substring(folder, F.length(root) + 1, F.length(folder)), link))))
    )
    return whole


def _dots(p: Column) -> Column:
    """Remove dot segments of a rooted path; what follows ? or # is left alone."""
    tail = F.regexp_extract(p, "([?#].*)$", 1)
    parts = F.split(F.substring(p, F.lit(2), F.length(p) - F.length(tail) - 1), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)),
    )
    slash = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), slash, tail)


def country(url: Column) -> Column:
    """Country of the top-level domain; null for others and for hosts without a dot."""
    net = netloc(url)
    tld = F.when(F.contains(net, F.lit(".")), F.lower(F.element_at(F.split(net, r"\."), -1)))
    pairs = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.try_element_at(pairs, tld)


def url_pattern(url: Column) -> Column:
    """Host without www. and the first path segment."""
    bare = F.regexp_replace(netloc(url), r"^www\.", "")
    first = F.get(F.split(F.trim(path(url), F.lit("/")), "/"), F.lit(0))
    return F.when(first == "", bare).otherwise(F.concat(bare, F.lit("/"), first))


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    h, out = host(url), F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith(f".{d}")
    return out
