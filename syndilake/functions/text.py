"""Titles, labels and numbers of reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that software leaves in place, normalised.
STOCK_TITLES = ("default title", "untitled", "no title", "title", "new post", "post title")
#: Namespaces that aren't extensions.
CORE_NAMESPACES = ("http://www.w3.org/2005/Atom", "http://www.w3.org/1999/xhtml", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/rss/1.0/")
#: Usual prefixes of namespaces, and where those are specified.
PREFIXES = {
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://purl.org/dc/terms/": "dcterms",
    "http://search.yahoo.com/mrss/": "media",
    "http://purl.org/rss/1.0/modules/content/": "content",
    "http://purl.org/rss/1.0/modules/slash/": "slash",
    "http://purl.org/rss/1.0/modules/syndication/": "sy",
    "http://purl.org/syndication/thread/1.0": "thr",
    "http://purl.org/syndication/thread/1.0#": "thr",
    "http://a9.com/-/spec/opensearchrss/1.0/": "opensearch",
    "http://www.w3.org/2003/01/geo/wgs84_pos#": "geo",
    "http://www.georss.org/georss/": "georss",
    "http://schemas.google.com/g/2005": "gd",
    "http://schemas.google.com/g/2005#": "gd",
    "http://www.itunes.com/dtds/podcast-1.0.dtd": "itunes",
    "http://wellformedweb.org/CommentAPI/": "wfw",
    "http://webfeeds.org/rss/1.0": "webfeeds",
    "http://purl.org/rss/1.0/modules/company/": "co",
    "http://purl.org/rss/1.0/modules/event/": "ev",
}
SPECIFICATIONS = {
    "co": "http://web.resource.org/rss/1.0/modules/company/",
    "content": "https://web.resource.org/rss/1.0/modules/content/",
    "dc": "https://www.dublincore.org/specifications/dublin-core/dces/",
    "dcterms": "https://www.dublincore.org/specifications/dublin-core/dcmi-terms/",
    "ev": "http://web.resource.org/rss/1.0/modules/event/",
    "gd": "https://developers.google.com/gdata/docs/1.0/elements",
    "geo": "https://www.w3.org/2003/01/geo/",
    "georss": "https://www.ogc.org/publications/standard/georss/",
    "itunes": "https://podcasters.apple.com/support/823-podcast-requirements",
    "media": "https://www.rssboard.org/media-rss",
    "opensearch": "https://github.com/dewitt/opensearch/blob/master/opensearch-1-1-draft-6.md",
    "slash": "http://web.resource.org/rss/1.0/modules/slash/",
    "sy": "https://web.resource.org/rss/1.0/modules/syndication/",
    "thr": "https://www.rfc-editor.org/rfc/rfc4685.html",
    "webfeeds": "https://webfeeds.org/rss/1.0",
    "wfw": "https://www.rssboard.org/comment-api",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def entry_title(text: Column) -> Column:
    """Lower case, white space collapsed; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def error_label(error: Column) -> Column:
    """First line, before a comma or a position; 160 characters at most; ParseError if that's empty."""
    line = F.trim(F.substring_index(F.regexp_replace(F.regexp_replace(F.coalesce(error, F.lit("")), r"^\s+", ""), r"[\r\n][\s\S]*$", ""), ",", 1))
    line = F.trim(F.regexp_replace(line, r":? line [0-9]+$", ""))
    return F.when(line == "", "ParseError").when(F.length(line) > 160, F.concat(F.substring(line, 1, 157), F.lit("..."))).otherwise(line)


def extension_label(ns: Column, local: Column) -> Column:
    """prefix:name for a known namespace, else the namespace and the name, with a # between unless one ends it."""
    between = F.when(ns.endswith("/") | ns.endswith("#"), "").otherwise("#")
    return F.coalesce(F.concat(_lookup(PREFIXES, ns), F.lit(":"), local), F.concat(ns, between, local))


def specification(label: Column) -> Column:
    """Where the label's prefix is specified, or null."""
    return F.when(label.rlike(r"^[^:]+:."), _lookup(SPECIFICATIONS, F.substring_index(label, ":", 1)))


def repeats(values: Column) -> dict[str, Column]:
    """n, repeated (all occurrences of values that come again), ratio (of four decimals), stock (titles) of an array."""
    own = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    sorted_ = F.array_sort(own)
    n = F.size(own)
    # equal neighbours in the sorted array: linear once it's sorted
    again = F.size(F.filter(sorted_, lambda v, i: (v == F.get(sorted_, i - 1)) | (v == F.get(sorted_, i + 1))))
    stock = F.size(F.filter(own, lambda v: v.isin(*STOCK_TITLES)))
    return {"n": n, "repeated": again, "ratio": F.when(n > 0, F.round(again / n, 4)).otherwise(0.0), "stock": stock}


def percent(part: Column, whole: Column) -> Column:
    """Of one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(0.0)
