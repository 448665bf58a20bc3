"""Routing of HTTP responses to the page, feed and sniffing branches, by column expressions in their order of cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content, platforms
from ..functions.url import normalize_url
from ..plans.quality import count_if
from .sites import with_site


def scoped(responses: DataFrame, top_sites: DataFrame | None, limit: int = 1_000_000, suffixes: DataFrame | None = None) -> DataFrame:
    """Responses with a URL, on one of the top sites if there are any given; a site that is empty is out.

    The site list is broadcast up to `limit` rows, and shuffled beyond. Sites come from a table of suffixes if one is given.
    """
    rows = with_site(responses.filter(F.coalesce("url", F.lit("")) != ""), F.col("url"), suffixes)
    if top_sites is None:
        return rows
    own = top_sites.select("site").filter(F.col("site") != "").distinct()
    small = own.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(own) if small else own, "site", "left_semi")


def routed(responses: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """responses with site, content_type, sniffed and route.

    route: html (any status, first bytes alone), feed (by media type) or sniffed (by first bytes), both with status 200;
    none for pages that aren't looked into; dropped for records that don't count as pages at all, because they aren't
    responses, or by their payload type or media type.
    """
    kind = platforms.header(F.col("http_headers"), "content-type")
    rows = responses if "site" in responses.columns else with_site(responses, F.col("url"), suffixes)
    rows = rows.withColumns({"content_type": content.media_type(kind), "_kind": kind})
    answered = F.col("record_type") == "response"
    paid = content.is_interesting_payload(F.col("payload_type"))
    page = F.coalesce(answered & paid & content.is_interesting(F.col("_kind")) & F.col("http_headers").isNotNull(), F.lit(False))
    c = F.col("content_type")
    fine = F.col("http_status") == 200
    guess = F.when(page & fine & content.is_sniffable(c) & ~content.is_feed_type(c) & ~c.contains("text/html"), content.sniff(F.col("body"))).otherwise("unknown")
    rows = rows.withColumns({"sniffed": guess, "_page": page})
    route = (
        F.when(~F.col("_page"), "dropped")
        .when(c.contains("text/html"), "html")
        .when(fine & content.is_feed_type(c), "feed")
        .when(F.col("sniffed") != "unknown", "sniffed")
        .otherwise("none")
    )
    return rows.withColumn("route", route).drop("_kind", "_page")


def html_pages(routes: DataFrame) -> DataFrame:
    """url, html: the first 12,288 bytes of pages."""
    return routes.filter("route = 'html'").select("url", F.substring("body", 1, content.HTML_BYTES).alias("html"))


def feed_responses(routes: DataFrame) -> DataFrame:
    """Responses to parse, with their normalised URL and why they are candidates."""
    source = F.when(F.col("route") == "feed", "feed_media_type").otherwise("sniffed")
    return routes.filter(F.col("route").isin("feed", "sniffed")).withColumns({"url": normalize_url(F.col("url")), "candidate_source": source})


def counters(routes: DataFrame) -> DataFrame:
    """One row: responses, pages, HTML pages, feeds by type and by sniffing, sites, latest crawl time."""
    page = F.col("route") != "dropped"
    return routes.agg(
        count_if(F.col("record_type") == "response").alias("responses_processed"),
        count_if(page).alias("pages_processed"),
        count_if(F.col("route") == "html").alias("html_pages"),
        count_if(F.col("route") == "feed").alias("feed_responses"),
        count_if(F.col("route") == "sniffed").alias("feeds_sniffed"),
        F.countDistinct(F.when(page & (F.col("site") != ""), F.col("site"))).alias("sites"),
        F.max(F.when(page, F.col("warc_date"))).alias("max_crawl_time"),
    )


def classified(status: Column, kind: Column, sniffed: Column) -> Column:
    """What a single response is: HTML page, feed by type, feed by sniffing, or something else."""
    feed = content.is_feed_type(kind)
    fine = status.between(200, 399)
    return F.when(feed, "feed").when(fine & content.is_sniffable(kind) & (sniffed != "unknown"), "sniffed feed").when(kind.contains("text/html"), "html").otherwise("other")
