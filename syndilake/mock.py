"""Made-up facts of any number, for trying out reports: hashes of a row's number choose everything.

Feeds, the pages that announce them, their links (one page in SEVERAL announces more than one feed), and counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import dates

FORMATS = (("rss2.0", 70), ("atom10", 24), ("rss10", 4), ("rss0.92", 2))
PLATFORMS = (("wordpress", 45), ("ghost", 6), ("drupal", 6), ("substack", 8), (None, 35))
LANGUAGES = (("en", 50), ("de", 12), ("fr", 10), ("es", 8), (None, 20))


#: One page in so many announces two to five feeds; feeds of a site.
SEVERAL, PER_SITE = 10, 8


def _hash(salt: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), "id"), F.lit(10_000))


def _pick(shares: tuple, salt: str, seed: int) -> Column:
    at, most, out = _hash(salt, seed) / 100, 0, None
    for value, share in shares:
        most += share
        out = F.when(at < most, F.lit(value)) if out is None else out.when(at < most, F.lit(value))
    return out


def feeds(spark: SparkSession, n: int, now: Column, seed: int = 42) -> DataFrame:
    """n rows of schema.FEEDS, the same for the same seed."""
    h = lambda salt: _hash(salt, seed)
    entries = (h("entries") % 60).cast("int")
    newest = F.timestamp_seconds(F.unix_seconds(now) - (F.pow(F.lit(2.0), h("age") / 1_000.0) * 43_200).cast("long"))
    oldest = F.timestamp_seconds(F.unix_seconds(newest) - (h("span") % 400) * dates.DAY)
    language, platform = _pick(LANGUAGES, "language", seed), _pick(PLATFORMS, "platform", seed)
    days = dates.cadence_days(newest, oldest, entries)
    ok = h("valid") >= 800
    one = lambda c: F.array_compact(F.array(c))
    own = {
        "url": F.concat(F.lit("https://site"), F.col("id"), F.lit(".example.com/feed")), "status": F.when(ok, 200).otherwise(404), "content_type": F.lit("application/rss+xml"), "charset": F.lit("utf-8"),
        "valid": ok, "error_type": F.when(~ok, F.when(h("why") < 5_000, "Not XML").otherwise("mismatched tag")), "format": _pick(FORMATS, "format", seed), "entries_count": entries,
        "title": F.when(h("title") < 9_500, F.concat(F.lit("Feed "), F.col("id"))), "link": F.concat(F.lit("https://site"), F.col("id"), F.lit(".example.com/")), "lang_feed": language, "languages": one(language), "all_languages": one(language),
        "lang_entries": F.array().cast("array<string>"), "has_summary": h("summary") < 8_000, "has_content": h("content") < 5_000, "content_type_profile": F.when(h("kind") < 7_000, "html").otherwise("plain"),
        "content_lengths": F.transform(F.sequence(F.lit(1), F.greatest(entries, F.lit(1))), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(3_000))).cast("int")), "fingerprints": one(platform),
        "extensions": F.when(h("extension") < 6_000, F.array(F.struct(F.lit("http://purl.org/dc/elements/1.1/").alias("ns"), F.lit("creator").alias("local")))), "candidate_sources": F.array(F.when(h("source") < 9_000, "feed_media_type").otherwise("sniffed")),
        "request_time": now, "updated_date": newest, "newest_entry_date": newest, "oldest_entry_date": oldest, "entry_title_count": entries, "repeated_entry_title_count": F.lit(0), "repeated_entry_title_ratio": F.lit(0.0),
        "default_entry_title_count": F.lit(0), "entry_link_count": entries, "repeated_entry_link_count": F.lit(0), "repeated_entry_link_ratio": F.lit(0.0), "has_self_link": h("self") < 6_000, "has_hub_link": h("hub") < 2_000,
        "has_paging_link": h("paging") < 500, "has_archive_link": h("archive") < 100, "update_cadence_days": F.round(days, 2), "update_cadence_bucket": dates.cadence_bucket(days), "has_hreflang": F.lit(False),
    }
    return spark.range(n).select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FEEDS.fields))


def links(spark: SparkSession, feeds_n: int, pages_n: int, seed: int = 42) -> DataFrame:
    """Rows of operators.pages.links(): what pages_n pages announce of feeds_n feeds."""
    h = lambda salt: _hash(salt, seed)
    more = F.when(h("several") % SEVERAL == 0, 2 + h("more") % 4).otherwise(1)
    each = spark.range(pages_n).withColumns({"platform": _pick(PLATFORMS, "page platform", seed), "k": F.explode(F.sequence(F.lit(0), (more - 1).cast("int")))})
    feed = F.pmod(F.xxhash64(F.lit(seed), "id") + F.col("k"), F.lit(max(1, feeds_n)))
    site = F.concat(F.lit("host"), F.floor(F.col("id") / PER_SITE).cast("string"), F.lit(".example.com"))
    both = F.array(F.lit("alternate"), F.lit("feed"))
    return each.select(
        F.concat(F.lit("https://"), site, F.lit("/p/"), F.col("id")).alias("page_url"), F.concat(F.lit("site"), (F.col("id") % 997).cast("string"), F.lit(".com")).alias("site"),
        F.concat(F.lit("https://site"), feed.cast("string"), F.lit(".example.com/feed")).alias("feed_url"), F.when(h("rel") < 9_000, F.array(F.lit("alternate"))).otherwise(both).alias("rels"),
        F.lit("application/rss+xml").alias("type"), F.concat(F.lit("Feed "), feed.cast("string")).alias("title"), F.lit("").alias("hreflang"), F.array_compact(F.array("platform")).alias("fingerprints"),
    )


def pages(spark: SparkSession, announced: DataFrame, silent: int, seed: int = 42) -> DataFrame:
    """Rows of operators.pages.described(): the pages of links, and so many without any."""
    known = announced.groupBy(F.col("page_url").alias("url")).agg(F.first("fingerprints").alias("fingerprints")).withColumn("has_links", F.lit(True))
    rest = spark.range(silent).select(F.concat(F.lit("https://quiet"), F.col("id"), F.lit(".example.net/")).alias("url"), F.array_compact(F.array(_pick(PLATFORMS, "quiet", seed))).alias("fingerprints"), F.lit(False).alias("has_links"))
    return known.unionByName(rest)


def counters(described: DataFrame, all_feeds: DataFrame, now: Column) -> DataFrame:
    """One row as of operators.routing.counters()."""
    html = described.agg(F.count(F.lit(1)).alias("html_pages"))
    sniffed = F.array_contains("candidate_sources", "sniffed")
    found = all_feeds.agg(F.count(F.when(~sniffed, 1)).alias("feed_responses"), F.count(F.when(sniffed, 1)).alias("feeds_sniffed"), F.countDistinct("url").alias("sites"))
    both = html.crossJoin(found)  # one row each
    whole = F.col("html_pages") + F.col("feed_responses") + F.col("feeds_sniffed")
    return both.select(whole.alias("responses_processed"), whole.alias("pages_processed"), "html_pages", "feed_responses", "feeds_sniffed", "sites", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("max_crawl_time"))
