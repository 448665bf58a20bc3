"""The report as a dictionary of small tables; feeds are scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import discovery, distributions, feeds, quality


def tables(all_feeds: DataFrame, links: DataFrame, pages: DataFrame, now: Column, page_types: DataFrame | None = None, html_pages: int | None = None, sites_seen: int = 0, suffixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the report. all_feeds: schema.FEEDS, one row for each URL; links: operators.pages.links(); pages: described().

    The scored feeds are kept for all of them; call .unpersist() on the entry "scores" when done.
    """
    valid = feeds.valid(all_feeds)
    scores = quality.scored(valid, now).persist()
    known = links.select(F.col("feed_url").alias("url")).distinct()
    found = scores.join(known, "url", "left_semi")
    several = discovery.several(links)
    out = {
        "scores": scores,
        "totals": feeds.totals(valid),
        "families": feeds.families(all_feeds),
        "formats": feeds.by_format(valid),
        "charsets": feeds.by_charset(valid),
        "languages": feeds.by_language(valid),
        "profiles": feeds.by_profile(valid),
        "language_counts": feeds.by_language_count(valid),
        "errors": feeds.errors(all_feeds),
        "sniffed": feeds.sniffed(all_feeds),
        "sites": feeds.sites(valid, suffixes),
        "entry_recency": distributions.recency(feeds.with_entries(valid), "newest_entry_date", now),
        "feed_recency": distributions.recency(valid, "updated_date", now),
        "discovered_recency": distributions.recency(found, "newest_entry_date", now),
        "cadence": distributions.cadence(valid),
        "entries": distributions.entry_histogram(valid, "entries_count"),
        "lengths": distributions.hundreds(valid),
        "quality": quality.summary(scores),
        "quality_histogram": quality.histogram(scores),
        "quality_by_format": quality.by_format(scores),
        "quality_split": quality.split(scores, links),
        "extension_prevalence": feeds.extension_prevalence(scores),
        "profile_prevalence": feeds.profile_prevalence(scores),
        "language_prevalence": feeds.language_prevalence(scores),
        "platform_prevalence": feeds.platform_prevalence(scores),
        "signal_prevalence": feeds.signal_prevalence(scores),
        "source_quality": discovery.source_quality(scores, discovery.sources(links)),
        "page_platforms": discovery.platform_table(pages),
        "pages_with_links": discovery.page_totals(links),
        "links_per_page": discovery.links_per_page(links),
        "feeds_per_site": discovery.feeds_per_site(links),
        "format_pairs": discovery.format_pairs(several, all_feeds),
        "discovery": discovery.summary(links, pages.count() if html_pages is None else html_pages, sites_seen, several, all_feeds),
    }
    if page_types is not None:
        out["content_types"] = feeds.by_content_type(page_types)
    return out
