"""python -m syndilake.cli crawl|opml|probe|mock: surveys and probes from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import mock
from .operators.sites import read_suffixes
from .report import render, survey
from .report.probe import probe
from .ship import ship
from .sources import fetch, lists, warc


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="syndilake")
    kinds = parser.add_subparsers(dest="kind", required=True)
    crawl = kinds.add_parser("crawl", help="survey WARC files")
    crawl.add_argument("warcs", help="paths, globs too, by commas; @file for a list of paths")
    crawl.add_argument("--prefix", default="", help="what paths of a list begin with, such as https://host/")
    crawl.add_argument("--suffixes", help="a public suffix list")
    crawl.add_argument("--top-sites", help="CSV of rank,domain")
    crawl.add_argument("--top", type=int, help="lines of it")
    crawl.add_argument("--limit", type=int, help="WARC files")
    crawl.add_argument("--limit-records", type=int, help="records of each file")
    subscriptions = kinds.add_parser("opml", help="survey a subscription list")
    subscriptions.add_argument("source")
    subscriptions.add_argument("--timeout", type=float, default=fetch.TIMEOUT)
    subscriptions.add_argument("--max-bytes", type=int, default=fetch.MOST)
    subscriptions.add_argument("--no-html", action="store_true")
    one = kinds.add_parser("probe", help="look at a URL")
    one.add_argument("url")
    one.add_argument("--recursive", action="store_true")
    one.add_argument("--max-feeds", type=int, default=10)
    logs = kinds.add_parser("timing", help="Markdown of task logs")
    logs.add_argument("folder")
    logs.add_argument("--top", type=int, default=10)
    made = kinds.add_parser("mock", help="write made-up feeds")
    made.add_argument("-n", type=int, default=50_000)
    for p in (crawl, subscriptions, made):
        p.add_argument("--facts", required=True, help="folder for the fact tables")
    for p in (crawl, subscriptions):
        p.add_argument("--out", default="report.html")
    own = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    epoch = F.timestamp_seconds(F.lit(0))
    if own.kind == "probe":
        print(probe(spark, own.url, recursive=own.recursive, most=own.max_feeds))
    elif own.kind == "timing":
        print(render.timing_summary(*lists.logs(spark, own.folder), own.top))
    elif own.kind == "mock":
        now = F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))
        made_feeds = survey.kept(mock.feeds(spark, own.n, now), f"{own.facts}/feeds")
        made_links = survey.kept(mock.links(spark, own.n, own.n), f"{own.facts}/links")
        made_pages = survey.kept(mock.pages(spark, made_links, own.n), f"{own.facts}/pages")
        survey.kept(mock.counters(made_pages, made_feeds, now), f"{own.facts}/counters")
    elif own.kind == "opml":
        def fetcher(url: str) -> tuple[int, dict[str, str], bytes]:
            return fetch.get(url, own.timeout, own.max_bytes)

        rows = survey.opml_responses(spark, lists.read_opml(spark, own.source), fetcher, not own.no_html)
        survey.report(survey.opml_facts(rows, epoch, own.facts), render.opml_title(own.source), own.out)
    else:
        options = {"limit_records": own.limit_records} if own.limit_records else {}
        if own.warcs.startswith("@"):
            rows = warc.read_warcs(spark, lists.paths(spark, own.warcs[1:], own.limit).withColumn("path", F.concat(F.lit(own.prefix), "path")), **options)
        else:
            rows = warc.read_warc(spark, own.warcs, **options)
        suffixes = read_suffixes(spark, own.suffixes) if own.suffixes else None
        top = lists.top_sites(spark, own.top_sites, own.top, suffixes) if own.top_sites else None
        routes = survey.staged(rows, top, own.facts, suffixes)
        survey.report(survey.facts(routes, epoch, own.facts, suffixes), f"Feeds of {own.warcs}", own.out, suffixes)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
