"""What pages announce: aggregates over links, platforms of the announcing pages, duplicate feeds of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.url import normalize_url_for_grouping
from .distributions import discovery_histogram
from .quality import count_if, high

#: Pages with several feeds of a sample, and rows of the report's tables.
SAMPLE, ROWS, PAIRS = 10_000, 15, 10


def per_page(links: DataFrame) -> DataFrame:
    """page_url, feeds (distinct), rels (of the page), both (feeds that are announced as alternate and as feed)."""
    tokens = links.groupBy("page_url", "feed_url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rels")))).alias("rels"))
    return tokens.groupBy("page_url").agg(
        F.count(F.lit(1)).alias("feeds"),
        F.max(F.array_contains("rels", "alternate")).alias("alternate"),
        F.max(F.array_contains("rels", "feed")).alias("feed"),
        count_if(F.size("rels") > 1).alias("both"),
    )


def page_totals(links: DataFrame) -> DataFrame:
    """One row: pages with links, with each rel, with both, feeds announced by both, pages with such."""
    return per_page(links).agg(
        F.count(F.lit(1)).alias("pages"),
        count_if(F.col("alternate")).alias("rel_alternate"),
        count_if(F.col("feed")).alias("rel_feed"),
        count_if(F.col("alternate") & F.col("feed")).alias("rel_both"),
        F.coalesce(F.sum("both"), F.lit(0)).alias("links_both"),
        count_if(F.col("both") > 0).alias("pages_links_both"),
    )


def links_per_page(links: DataFrame) -> DataFrame:
    """Pages by how many feeds they announce; "0" isn't shown."""
    return discovery_histogram(per_page(links), "feeds").filter(F.col("label") != "0")


def feed_counts(links: DataFrame) -> DataFrame:
    """Occurrences of links to each feed, and distinct sites that have them."""
    return links.groupBy("feed_url").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("site").alias("sites"))


def with_counts(feeds: DataFrame, links: DataFrame) -> DataFrame:
    """feeds with links and sites, 0 where no page announces them."""
    return feeds.join(feed_counts(links).withColumnRenamed("feed_url", "url"), "url", "left").na.fill(0, ["links", "sites"])


def feeds_per_site(links: DataFrame) -> DataFrame:
    each = links.groupBy("site").agg(F.countDistinct("feed_url").alias("feeds"))
    return discovery_histogram(each, "feeds").filter(F.col("label") != "0")


def sources(links: DataFrame) -> DataFrame:
    """feed_url, label, n: platforms of the pages that announce a feed; a page counts once for each of its labels."""
    own = F.when(F.size("fingerprints") > 0, F.col("fingerprints")).otherwise(F.array(F.lit("unknown")))
    return links.select("page_url", "feed_url", F.explode(own).alias("label")).distinct().groupBy("feed_url", "label").agg(F.count(F.lit(1)).alias("n"))


def source_quality(scores: DataFrame, source_labels: DataFrame, limit: int = ROWS) -> DataFrame:
    """Quality by the platform of announcing pages; "unknown" is kept, in the last row's place if need be."""
    own = scores.select("url", "score").join(source_labels.select(F.col("feed_url").alias("url"), "label").distinct(), "url", "left")
    rows = own.groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("feeds"), count_if(high()).alias("quality"), F.round(F.avg("score"), 6).alias("mean"))
    order = [F.desc("feeds"), F.col("label")]
    place = F.row_number().over(Window.orderBy(*order))  # labels of platforms: tens of rows
    rank = F.col("_place")
    unknown = F.max(F.when(F.col("label") == "unknown", rank)).over(Window.partitionBy())
    kept = F.when(F.coalesce(unknown, F.lit(0)) > limit, (rank < limit) | (rank == unknown)).otherwise(rank <= limit)
    return rows.withColumn("_place", place).withColumn("_kept", kept).filter("_kept").drop("_place", "_kept").orderBy(*order)


def page_platforms(pages: DataFrame) -> DataFrame:
    """label, pages, auto_pages (that announce feeds) of pages (fingerprints, has_links)."""
    return pages.select(F.explode("fingerprints").alias("label"), "has_links").groupBy("label").agg(F.count(F.lit(1)).alias("pages"), count_if(F.col("has_links")).alias("auto_pages"))


def platform_table(pages: DataFrame, limit: int = ROWS) -> DataFrame:
    """page_platforms() and a row for pages without any."""
    labelled = F.size("fingerprints") > 0
    unknown = pages.agg(F.lit("unknown").alias("label"), count_if(~labelled).alias("pages"), count_if(~labelled & F.col("has_links")).alias("auto_pages"), F.count(F.lit(1)).alias("_all"))
    rows = page_platforms(pages).unionByName(unknown.filter("_all > 0").drop("_all"))
    return rows.withColumn("pct", text.percent(F.col("auto_pages"), F.col("pages"))).orderBy(F.desc("pages"), "label").limit(limit)


def several(links: DataFrame, limit: int | None = None) -> DataFrame:
    """page_url, feeds: pages that announce several feeds; with a limit a sample of so many, by hash of the page.

    A page's feeds are bounded by the bytes of a page that are read.
    """
    pages = links.groupBy("page_url").agg(F.array_sort(F.collect_set("feed_url")).alias("feeds")).filter(F.size("feeds") > 1)
    return pages if limit is None else pages.orderBy(F.md5("page_url"), "page_url").limit(limit)


def same_feeds(pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """page_url, link, title, copies, formats (format, n): feeds of a page that share a link (without query) and a title.

    Feeds without both, and URLs that aren't among feeds, are left out. Links are normalised once, before they meet
    pages; formats are counted, so that a group has a row for each of them at most.
    """
    each = pages.select("page_url", F.explode("feeds").alias("url"))
    link, title = F.coalesce("link", F.lit("")), text.entry_title(F.col("title"))
    own = feeds.filter((link != "") | (title != "")).select("url", F.when(link != "", normalize_url_for_grouping(F.col("link"))).alias("link"), title.alias("title"), F.coalesce("format", F.lit("unknown")).alias("format"))
    met = each.join(own, "url").groupBy("page_url", "link", "title", "format").agg(F.count(F.lit(1)).alias("n"))
    counted = F.array_sort(F.collect_list(F.struct("format", "n"))).alias("formats")
    return met.groupBy("page_url", "link", "title").agg(F.sum("n").alias("copies"), counted).filter("copies > 1")


def duplicate_pages(pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """page_url, extra: copies beyond the first."""
    return same_feeds(pages, feeds).groupBy("page_url").agg((F.sum("copies") - F.count(F.lit(1))).alias("extra"))


def format_pairs(pages: DataFrame, feeds: DataFrame, limit: int = PAIRS) -> DataFrame:
    """Pairs of formats among the copies of a feed on a page, every two of them, by counts of formats: no pairs of rows."""
    paired = F.flatten(F.transform("formats", lambda x, i: F.transform(F.slice("formats", i + 1, F.size("formats")), lambda y: F.struct(
        F.concat(x["format"], F.lit(" and "), y["format"]).alias("pair"),
        F.when(x["format"] == y["format"], F.floor(x["n"] * (x["n"] - 1) / 2)).otherwise(x["n"] * y["n"]).cast("long").alias("n")))))
    each = same_feeds(pages, feeds).select(F.explode(paired).alias("p")).select("p.*")
    return each.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("n"), "pair").limit(limit)


def summary(links: DataFrame, html_pages: Column | int, sites_seen: Column | int, pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row: pages and sites with and without links, pages with several feeds, and how many of those repeat a feed."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    found = links.agg(F.countDistinct("page_url").alias("pages"), F.countDistinct("site").alias("sites"))
    repeats = duplicate_pages(pages, feeds).agg(F.count(F.lit(1)).alias("duplicate_pages"))
    several_ = pages.agg(F.count(F.lit(1)).alias("several"))
    rows = found.crossJoin(several_).crossJoin(repeats)  # one row each
    return rows.select(
        "pages",
        F.greatest(F.lit(0), lit(html_pages) - F.col("pages")).alias("zero_pages"),
        "sites",
        F.greatest(F.lit(0), lit(sites_seen) - F.col("sites")).alias("zero_sites"),
        "several",
        "duplicate_pages",
        text.percent(F.col("duplicate_pages"), F.col("several")).alias("duplicate_pct"),
    )
