"""URL columns: canonical form, host rules, links of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides those that start with utm_.
TRACKING = ["spm", "from", "source", "ref", "referrer", "gclid", "fbclid"]
#: File types that aren't pages.
NOT_PAGES = ["jpg", "jpeg", "png", "gif", "webp", "svg", "pdf", "zip", "rar", "7z", "doc", "docx", "xls", "xlsx"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))


def _recoded(part: Column) -> Column:
    """One side of a query parameter, decoded and encoded again as forms are; broken escapes stay as text."""
    plain = F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slashes, path parameters, fragment or tracking parameters, queries
    encoded in one way (a name without a value gets an empty one); null unless http(s)."""
    u = F.trim(url)
    scheme, place = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r";[^/]*$", ""), r"/+$", "")
    query = F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&")
    pairs = F.transform(F.filter(query, lambda p: p != ""), lambda p: F.struct(_recoded(F.regexp_extract(p, "^[^=]*", 0)).alias("name"), _recoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(TRACKING) & ~F.startswith(F.lower(p["name"]), F.lit("utm_")))
    encoded = F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    out = F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(encoded, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & (place != ""), out)


def is_allowed(url: Column, domains: list[str]) -> Column:
    """The host ends with all labels of one of the domains: compared label by label from the top domain down."""
    labels = F.reverse(F.split(host(url), r"\."))
    tops = [[x for x in reversed(d.strip().lower().split(".")) if x] for d in domains]
    return F.exists(F.array(*(F.array(*map(F.lit, t)) for t in tops if t)), lambda t: F.slice(labels, 1, F.size(t)) == t)


def is_page(url: Column) -> Column:
    """The path doesn't end in a file type that isn't a page."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1))
    return ~F.regexp_extract(path, r"\.([a-z0-9]+)$", 1).isin(NOT_PAGES)


def links(html: Column) -> Column:
    """The href of every anchor, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def absolute(link: Column, page: Column) -> Column:
    """A link that starts with a slash, on its page's host; others as they are."""
    return F.when(F.startswith(link, F.lit("/")), F.concat(F.regexp_extract(page, r"^([A-Za-z]+://[^/?#]+)", 1), link)).otherwise(link)


def content_hash(title: Column, content: Column) -> Column:
    """sha-256 of title and content on two lines, white space collapsed, lower case; null when both are blank."""
    text = F.lower(F.trim(F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), r"\s+", " ")))
    return F.when(text != "", F.sha2(text, 256))
