"""Addresses as column functions: canonical form, resolving, what a crawl may follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of files that are no pages, folders of sources and pictures.
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".pdf", ".ico", ".css", ".js", ".xml", ".txt")
NO_PAGES = ("/_sources/", "/_images/", "/images/", "/storage/")
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query with its question mark; empty where there is none."""
    return F.regexp_extract(url, SPLIT, i)


def host(url: Column) -> Column:
    """The host name in small letters, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def canonical(url: Column) -> Column:
    """Trimmed, without fragment, scheme and host in small letters, no slash at the end of a longer path."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme, net, path = F.lower(part(u, 1)), F.lower(part(u, 2)), F.coalesce(F.nullif(part(u, 3), F.lit("")), F.lit("/"))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""), path, part(u, 4))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as it is meant on the page ``base``; dots in paths are followed."""
    scheme, net, path, query = (part(link, i) for i in (1, 2, 3, 4))
    above = F.regexp_replace(part(base, 3), "[^/]*$", "")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(above == "", "/").otherwise(above), path))
    steps = F.split(F.regexp_replace(joined, "^/", ""), "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    folder = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    whole = F.concat(F.lit("/"), F.array_join(walked, "/"), folder)
    own = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    return (
        F.when(scheme != "", link).when(net != "", F.concat(part(base, 1), F.lit(":"), link))
        .when((path == "") & (query == ""), F.concat(own, part(base, 3), part(base, 4))).when(path == "", F.concat(own, part(base, 3), query)).otherwise(F.concat(own, whole, query))
    )


def internal(base: Column, url: Column, subdomains: bool = True) -> Column:
    """Whether a resolved address is a page of the host of ``base``, or of a host below it."""
    same = host(url) == host(base)
    below = host(url).endswith(F.concat(F.lit("."), host(base))) & (host(base) != "")
    return F.lower(part(url, 1)).isin("http", "https") & ((host(url) == "") | (same | below if subdomains else same))


def in_subtree(home: Column, url: Column) -> Column:
    """Both canonical: same scheme and host, under the folder of ``home``, a page."""
    path, low = part(url, 3), F.lower(part(url, 3))
    under = path.startswith(F.regexp_replace(part(home, 3), "[^/]*$", ""))
    asset = low.endswith(ASSETS[0])
    for a in ASSETS[1:]:
        asset = asset | low.endswith(a)
    for folder in NO_PAGES:
        asset = asset | low.contains(folder)
    return (part(url, 1) != "") & (part(url, 2) != "") & (part(url, 1) == part(home, 1)) & (part(url, 2) == part(home, 2)) & under & ~asset


def of_source(url: Column, domains: Column, prefixes: Column, excluded: Column, unstable: tuple[str, ...]) -> Column:
    """Canonical ``url`` of a registered source: one of its hosts and prefixes, none of its patterns, nowhere that isn't stable."""
    low = F.lower(url)
    shaky = F.lit(False)
    for hint in unstable:
        shaky = shaky | low.contains(hint)
    fits = F.array_contains(domains, host(url)) & F.exists(prefixes, lambda p: url.startswith(p))
    return F.lower(part(url, 1)).isin("http", "https") & fits & ~F.exists(F.coalesce(excluded, F.array().cast("array<string>")), lambda p: F.rlike(url, p)) & ~shaky


def hrefs(html: Column) -> Column:
    """The targets of a page's links, in order."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.replace(F.regexp_replace(x, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))), lambda x: x != "")
