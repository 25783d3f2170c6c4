"""URL columns: parts, joins, hosts, URLs named in prose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainledger.functions.values import any_of, col, yes

# The generic URI pattern of RFC 3986, appendix B.
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
# A URL inside prose and the marks that end a sentence, not a URL.
PROSE_URL = r"(?i)https?://[^\s\]\)\>\"']+"
TRAILING_MARKS = r"[.,;)\]}'\"]+$"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), URI, 1))


def netloc(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), URI, 2))


def host(url: Column | str) -> Column:
    """Lower-case authority without a leading `www.`."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def raw_path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), URI, 3)


def percent_decode(text: Column) -> Column:
    """Percent decoding that leaves `+` alone and keeps undecodable text."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def path(url: Column | str) -> Column:
    return percent_decode(raw_path(url))


def file_name(url: Column | str) -> Column:
    last = F.substring_index(path(url), "/", -1)
    return F.when(last == "", "download").otherwise(last)


def label_from_url(url: Column | str) -> Column:
    last = F.substring_index(F.rtrim(path(url), F.lit("/")), "/", -1)
    return F.when(last == "", netloc(url)).otherwise(last)


def looks_like_pdf(url: Column | str) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_http(url: Column | str) -> Column:
    return yes(scheme(url).isin("http", "https"))


def http_url(url: Column | str) -> Column:
    text = F.trim(col(url))
    return F.when(is_http(text) & (netloc(text) != ""), text)


def same_resource(a: Column | str, b: Column | str) -> Column:
    """Equal scheme, host and path, a trailing slash aside."""
    def bare(u: Column | str) -> Column:
        cut = F.rtrim(raw_path(u), F.lit("/"))
        return F.when(cut == "", "/").otherwise(cut)

    return (scheme(a) == scheme(b)) & (netloc(a) == netloc(b)) & (bare(a) == bare(b))


def host_matches(url: Column | str, domain: str) -> Column:
    """Host is the domain or lies under it; a port or user does not count."""
    name = F.regexp_replace(F.regexp_replace(netloc(url), r"^[^@]*@", ""), r":\d+$", "")
    return (name == domain) | name.endswith("." + domain)


def is_example(url: Column | str) -> Column:
    return col(url).startswith("http") & (
        host_matches(url, "example.com") | raw_path(url).contains("/example/")
    )


def media_for(url: Column | str) -> Column:
    """pdf, html or other by the path's ending; a last part without a dot is html."""
    low = F.lower(path(url))
    page = any_of(*[low.endswith(x) for x in (".html", ".htm", ".aspx", ".shtml", "/")])
    plain = ~F.substring_index(low, "/", -1).contains(".")
    return F.when(low.endswith(".pdf"), "pdf").when(page | plain, "html").otherwise("other")


def inferred_media(media: Column | str, url: Column | str) -> Column:
    """Stated media when valid, else by the URL's ending before any query."""
    low = F.lower(F.substring_index(F.coalesce(col(url), F.lit("")), "?", 1))
    page = any_of(*[low.endswith(x) for x in (".html", ".htm", ".aspx", ".shtml", "/")])
    return (
        F.when(col(media).isin("pdf", "html", "other"), col(media))
        .when(low.endswith(".pdf"), "pdf").when(page, "html").otherwise("other")
    )


def _collapse(p: Column) -> Column:
    """Resolve `.` and `..` parts of an absolute path."""
    start = F.array().cast("array<string>")
    parts = F.split(F.substring(p, F.lit(2), F.length(p)), "/")

    def step(acc: Column, part: Column) -> Column:
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == ".", acc).when(part == "..", shorter).otherwise(F.array_append(acc, part))

    kept = F.aggregate(parts, start, step)
    closed = F.when(p.rlike(r"/\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    full = F.concat(F.lit("/"), F.array_join(closed, "/"))
    return F.when(p.rlike(r"/\.\.?(/|$)"), full).otherwise(p)


def base_parts(base: Column | str) -> Column:
    """What resolving links on a page needs of its URL, read once per page."""
    b = col(base)
    folder = F.regexp_extract(raw_path(b), r"^(.*/)", 1)
    return F.struct(
        scheme(b).alias("scheme"),
        F.concat(scheme(b), F.lit("://"), F.regexp_extract(b, URI, 2)).alias("origin"),
        F.when(folder == "", "/").otherwise(folder).alias("folder"),
        F.regexp_extract(b, r"^([^?#]*)", 1).alias("bare"),
        F.substring_index(b, "#", 1).alias("whole"),
    )


def resolve_from(parts: Column, href: Column) -> Column:
    """Absolute URL of a link, its fragment already cut off, from `base_parts`."""
    link_path = F.regexp_extract(href, r"^([^?]*)", 1)
    query = F.substring(href, F.length(link_path) + 1, F.length(href))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(parts["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(parts["origin"], _collapse(link_path), query))
        .when(href.startswith("?"), F.concat(parts["bare"], href))
        .when(href == "", parts["whole"])
        .otherwise(F.concat(parts["origin"], _collapse(F.concat(parts["folder"], link_path)), query))
    )


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute URL of a link on a page; the fragment is dropped."""
    return resolve_from(base_parts(base), F.substring_index(col(href), "#", 1))


def prose_urls(*texts: Column | str, seeds: Sequence[Column | str] = ()) -> Column:
    """Distinct URLs of seeds and prose in first-seen order, closing marks cut off."""
    found = [F.array(F.coalesce(col(s), F.lit(""))) for s in seeds]
    found += [F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit(PROSE_URL), F.lit(0)) for t in texts]
    flat = F.transform(F.concat(*found), lambda u: F.regexp_replace(u, TRAILING_MARKS, ""))
    return F.array_distinct(F.filter(flat, lambda u: u.startswith("http")))


def trusted_urls(listed: Column, seeds: Sequence[Column | str]) -> Column:
    """Packet URLs that may be followed: seeds, their hosts, government hosts.

    Without any seed every listed URL is trusted.
    """
    seed = F.filter(F.array(*[F.coalesce(col(s), F.lit("")) for s in seeds]), lambda u: u.startswith("http"))
    hosts = F.transform(seed, host)

    def ok(u: Column) -> Column:
        h = host(u)
        return F.array_contains(seed, u) | F.array_contains(hosts, h) | h.endswith(".gov") | h.endswith(".mil")

    return F.when(F.size(seed) == 0, listed).otherwise(F.filter(listed, ok))
