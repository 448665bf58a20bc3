"""From responses to facts to a report: the crawl survey, and the survey of a subscription list."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content
from ..operators import feeds, pages, routing
from ..plans import feeds as reports
from ..sources import fetch
from . import render
from .tables import tables


def kept(frame: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """A frame as a Parquet table, and read again."""
    out = frame.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)
    return frame.sparkSession.read.parquet(path)


def staged(responses: DataFrame, top_sites: DataFrame | None, folder: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Routed responses as a table with a part for each route: the sources are read this once.

    Bodies are kept where something reads them: the first bytes of pages, all of feeds, nothing of the rest.
    """
    routes = routing.routed(routing.scoped(responses, top_sites, suffixes=suffixes))
    feed = F.when(F.col("route").isin("feed", "sniffed"), F.substring("body", 1, content.FEED_BYTES))
    body = F.when(F.col("route") == "html", F.substring("body", 1, content.HTML_BYTES)).otherwise(feed)
    return kept(routes.withColumn("body", body), f"{folder}/routes", by="route")


def facts(routes: DataFrame, now: Column, folder: str, suffixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Writes and gives feeds (one for each URL), links, pages, page_types and counters of staged responses."""
    html = routing.html_pages(routes)
    links = kept(pages.links(html, suffixes=suffixes), f"{folder}/links")
    return {
        "links": links,
        "pages": kept(pages.described(html, links), f"{folder}/pages"),
        "feeds": kept(reports.latest(feeds.records(routing.feed_responses(routes), now)), f"{folder}/feeds"),
        "page_types": routes.filter("route <> 'dropped'").select("content_type"),
        "counters": kept(routing.counters(routes), f"{folder}/counters"),
    }


def report(tables_of: dict[str, DataFrame], heading: str, path: str, suffixes: DataFrame | None = None) -> dict[str, str]:
    """Writes HTML to a path and Markdown beside it; the newest crawl date stands for now."""
    counters = tables_of["counters"].first()
    now = F.to_timestamp(F.lit(counters["max_crawl_time"] or "1970-01-01T00:00:00Z"))
    made = tables(*(tables_of[t] for t in ("feeds", "links", "pages")), now, tables_of["page_types"], counters["html_pages"], counters["sites"], suffixes)
    data = render.collected(made)
    made["scores"].unpersist()
    out = {path: render.page(heading, data), render.beside(path): render.markdown(heading, data)}
    for name, text in out.items():
        Path(name).write_text(text, encoding="utf-8")
    return out


def opml_responses(spark: SparkSession, entries: DataFrame, fetcher: fetch.Fetcher = fetch.get, check_html: bool = True) -> DataFrame:
    """Responses of a list's feeds, and of their pages."""
    own = fetch.fetched(entries.select(F.col("feed_url").alias("url")), fetcher, source="opml")
    if not check_html:
        return own
    return own.unionByName(fetch.fetched(entries.select(F.col("html_url").alias("url")), fetcher, source="page"))


def opml_facts(responses: DataFrame, now: Column, folder: str) -> dict[str, DataFrame]:
    """Facts of a list: any answer of a feed is parsed, any answer of a page is looked through, at full length."""
    responses = kept(responses, f"{folder}/responses")  # nothing is fetched again
    of_pages = responses.filter("candidate_source = 'page'")
    html = of_pages.filter(feeds.answered(F.col("http_status"))).select("url", F.col("body").alias("html"))
    links = kept(pages.links(html), f"{folder}/links")
    counted = routing.counters(routing.routed(of_pages)).drop("max_crawl_time")
    return {
        "links": links,
        "pages": kept(pages.described(html, links), f"{folder}/pages"),
        "feeds": kept(reports.latest(feeds.records(responses.filter("candidate_source = 'opml'"), now)), f"{folder}/feeds"),
        "page_types": routing.routed(of_pages).select("content_type"),
        "counters": kept(counted.crossJoin(responses.agg(F.max("warc_date").alias("max_crawl_time"))), f"{folder}/counters"),  # one row each
    }
