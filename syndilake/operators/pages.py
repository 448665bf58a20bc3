"""Feed autodiscovery: `<link>` elements of pages, by a cheap test of bytes and then a tokeniser of HTML."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import content, platforms
from ..functions.url import normalize_url
from .sites import with_site

#: Fixed values, since they decide which pages are looked into: both must be in a page before it's tokenised.
LINKED = r"(?i)<link\s+[^>]*rel\s*=\s*[\"'][^\"']*(alternate|feed)[^\"']*[\"'][^>]*>"
TYPED = r"(?i)type\s*=\s*[\"']application/(rss\+xml|atom\+xml|rdf\+xml)(\s*;[^\"']*)?[\"']"


class Links(HTMLParser):
    """Attributes of the link elements; comments, scripts and styles are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "link":
            self.found.append({k: v or "" for k, v in reversed(attrs)})


def announced(page_url: str, html: bytes) -> list[dict]:
    """Links of a page to feeds, repeats too, as rows of schema.LINK; URLs are resolved but not normalised."""
    reader = Links()
    reader.feed(html.decode("utf-8", "replace"))
    out = []
    for link in reader.found:
        kind, rels = link.get("type", "").lower(), set(link.get("rel", "").lower().split()) & {"alternate", "feed"}
        if not rels or not link.get("href") or not any(t in kind for t in content.LINK_TYPES):
            continue
        try:
            target = urljoin(page_url, link["href"])
        except ValueError:
            continue
        out.append({"feed_url": target, "rels": sorted(rels), "type": kind, "title": link.get("title", ""), "hreflang": link.get("hreflang", "")})
    return out


def _extracted(url: Column, html: Column) -> Column:
    @F.pandas_udf(f"array<{schema.LINK.simpleString()}>")
    def each(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([announced(u or "", p) if p else [] for u, p in zip(urls, pages)])

    return each(url, html)


def likely(html: Column) -> Column:
    """By bytes alone: may the page announce a feed? Attributes without quotes don't count."""
    text = F.decode(html, "ISO-8859-1")
    return F.coalesce(text.rlike(LINKED) & text.rlike(TYPED), F.lit(False))


def links(pages: DataFrame, prefilter: bool = True, suffixes: DataFrame | None = None) -> DataFrame:
    """page_url, site, feed_url, rels, type, title, hreflang, fingerprints: a row for each occurrence of a link.

    pages: url, html (binary). Python gets only pages that pass the test of bytes, and those two columns.
    """
    html = F.col("html").cast("binary")
    own = pages.select(F.col("url").alias("page_url"), html.alias("html"))
    own = own.filter(likely(F.col("html"))) if prefilter else own
    each = own.select("page_url", platforms.of_html(F.col("html")).alias("fingerprints"), F.explode(_extracted(F.col("page_url"), F.col("html"))).alias("link"))
    return with_site(each, F.col("page_url"), suffixes).select("page_url", "site", normalize_url(F.col("link.feed_url")).alias("feed_url"), "link.rels", "link.type", "link.title", "link.hreflang", "fingerprints")


def described(pages: DataFrame, found: DataFrame) -> DataFrame:
    """url, fingerprints, has_links of every page."""
    own = pages.select("url", platforms.of_html(F.col("html").cast("binary")).alias("fingerprints"))
    return own.join(found.select(F.col("page_url").alias("url"), F.lit(True).alias("has_links")).distinct(), "url", "left").na.fill(False, ["has_links"])
