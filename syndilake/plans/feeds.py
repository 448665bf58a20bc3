"""Aggregates over valid feeds: totals, languages, profiles, prevalence of labels, errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content, text
from ..operators.sites import with_site
from .quality import _c, _some, count_if, high, usable

#: Roots of documents that aren't feeds, listed one by one up to this many.
ROOTS = 15
_NO_STRINGS = "array<string>"


def strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_NO_STRINGS))


def valid(feeds: DataFrame) -> DataFrame:
    return feeds.filter(usable())


def with_entries(feeds: DataFrame) -> DataFrame:
    return feeds.filter(F.col("entries_count") > 0)


def totals(feeds: DataFrame) -> DataFrame:
    """One row of counts: content, summary or neither; entries; dates; repeated and stock titles; the nine of languages()."""
    some = _c("entries_count", 0) > 0
    has_content, has_summary = _c("has_content", False), _c("has_summary", False)
    return feeds.agg(
        F.count(F.lit(1)).alias("feeds"),
        count_if(has_content).alias("with_content"),
        count_if(~has_content & has_summary).alias("with_summary"),
        count_if(~has_content & ~has_summary).alias("with_neither"),
        F.coalesce(F.sum("entries_count"), F.lit(0)).alias("entries"),
        count_if(some).alias("with_entries"),
        count_if(some & F.col("newest_entry_date").isNotNull()).alias("with_entry_dates"),
        count_if(F.col("updated_date").isNotNull()).alias("with_updated_date"),
        count_if(_c("repeated_entry_title_count", 0) > 0).alias("with_repeated_titles"),
        count_if(_c("default_entry_title_count", 0) > 0).alias("with_stock_titles"),
        count_if(_c("repeated_entry_link_count", 0) > 0).alias("with_repeated_links"),
        *languages(),
    )


def languages() -> list[Column]:
    """Nine counts: where languages are told, and whether what is told agrees."""
    http, feed = _c("lang_http", ""), _c("lang_feed", "")
    entry = F.array_distinct(strings("lang_entries"))
    hreflang = _c("has_hreflang", False) | _some("hreflang_values")
    own = F.filter(F.array("lang_http", "lang_feed"), lambda x: x.isNotNull() & (x != ""))
    context = F.when(_c("entries_count", 0) > 0, F.array_union(entry, own)).otherwise(entry)
    tests = {
        "lang_src_http": http != "",
        "lang_src_feed": feed != "",
        "lang_src_entry": F.size(entry) > 0,
        "lang_mismatches": (feed != "") & (http != "") & (http != feed),
        "lang_multiple_in_feed": F.size(strings("all_languages")) > 1,
        "lang_no_info": (http == "") & (feed == "") & (F.size(entry) == 0) & ~hreflang,
        "lang_http_feed": (http != "") & (feed != ""),
        "lang_hreflang": hreflang,
        "lang_multiple_entry_languages": F.size(context) > 1,
    }
    return [count_if(test).alias(name) for name, test in tests.items()]


def counted(feeds: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return feeds.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def by_format(feeds: DataFrame) -> DataFrame:
    return counted(feeds, _c("format", "unknown"), "format")


def by_charset(feeds: DataFrame) -> DataFrame:
    named = F.when(_c("charset", "") == "", "unknown").otherwise(F.col("charset"))
    return feeds.groupBy(_c("format", "unknown").alias("format"), named.alias("charset")).agg(F.count(F.lit(1)).alias("n"))


def by_language(feeds: DataFrame) -> DataFrame:
    own = strings("languages")
    return counted(feeds.select(F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("unknown")))).alias("language")), F.col("language"), "language")


def by_extension(feeds: DataFrame) -> DataFrame:
    """Feeds with each extension, by label; namespaces with the same label are one."""
    each = feeds.select(F.explode("extensions").alias("x")).select(text.extension_label(F.col("x.ns"), F.col("x.local")).alias("extension"))
    return counted(each, F.col("extension"), "extension")


def spined(rows: DataFrame, labels: tuple[str, ...], name: str) -> DataFrame:
    """A row for each label, in that order, with 0 where there was none."""
    spine = rows.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], f"place int, {name} string")
    return F.broadcast(spine).join(rows, name, "left").select("place", name, F.coalesce("n", F.lit(0)).alias("n")).orderBy("place").drop("place")


def by_profile(feeds: DataFrame) -> DataFrame:
    return spined(counted(feeds, _c("content_type_profile", "unknown"), "profile"), content.PROFILES, "profile")


def by_language_count(feeds: DataFrame) -> DataFrame:
    many = F.least(F.size(strings("all_languages")), F.lit(3))
    bucket = F.when(many == 3, "3+").otherwise(many.cast("string"))
    return spined(counted(feeds, bucket, "languages"), ("0", "1", "2", "3+"), "languages")


def by_content_type(pages: DataFrame) -> DataFrame:
    """Pages of each of the five classes of media types."""
    return spined(counted(pages.filter(F.col("content_type") != ""), content.collapsed_type(F.col("content_type")), "class"), content.COLLAPSED, "class")


def families(feeds: DataFrame) -> DataFrame:
    """Feeds in formats of the RSS and Atom families, those that parsed, and those that didn't."""
    form = _c("format", "")
    own = usable()
    return feeds.agg(
        F.count(F.lit(1)).alias("feeds"),
        count_if(own).alias("parsed"),
        count_if(~own).alias("unparsed"),
        count_if(own & form.startswith("rss")).alias("rss"),
        count_if(own & form.startswith("atom")).alias("atom"),
    )


def sniffed(feeds: DataFrame) -> DataFrame:
    """Valid feeds that only their bytes gave away, by family."""
    form = _c("format", "")
    family = F.when(form.startswith("rss") | form.startswith("rdf"), "rss").when(form.startswith("atom"), "atom").otherwise("other")
    own = feeds.filter(usable() & F.array_contains(strings("candidate_sources"), "sniffed"))
    return spined(counted(own, family, "family"), ("rss", "atom", "other"), "family")


def sites(feeds: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Distinct sites that host feeds.

    Empty ones become null instead of being filtered: a filter would be pushed below what made feeds of many rows.
    """
    return with_site(feeds.select("url"), F.col("url"), suffixes).agg(F.countDistinct(F.nullif("site", F.lit(""))).alias("sites"))


def errors(feeds: DataFrame) -> DataFrame:
    """label, n, folded: feeds that failed, by type, message or status; the tail of unknown roots is one row, last."""
    told = _c("error", "")
    status = F.when(_c("status", 0) != 0, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise("Error")
    label = F.when(_c("error_type", "") != "", F.col("error_type")).when(F.col("error").isNotNull(), text.error_label(told)).otherwise(status)
    found = counted(feeds.filter(~usable()), label)
    root = F.col("label").startswith("Unknown root tag: ")
    first = found.filter(root).orderBy(F.desc("n"), "label").limit(ROOTS).select("label", F.lit(False).alias("folded"))
    kept = found.join(F.broadcast(first), "label", "left").withColumn("folded", root & F.coalesce("folded", F.lit(True)))  # ROOTS rows
    kept = kept.groupBy(F.when(F.col("folded"), "Other unknown root tags").otherwise(F.col("label")).alias("label"), "folded").agg(F.sum("n").alias("n"))
    return kept.select("label", "n", "folded").orderBy("folded", F.desc("n"), "label")


def prevalence(scores: DataFrame, labels: Column | Callable[[], Column], limit: int | None = None, seeded: tuple[str, ...] = ()) -> DataFrame:
    """Per label: feeds with it, and those above 0.5 among them, with both shares.

    A feed counts once for a label. `labels` is a column of arrays of strings. Seeded labels have a row even if no feed
    has them. quality_pct is of all feeds above 0.5, within_pct of the label's own.
    """
    own = labels() if callable(labels) else labels
    whole = scores.agg(F.count(F.lit(1)).alias("feeds"), count_if(high()).alias("quality_denominator"))
    each = scores.select(F.explode(F.array_distinct(F.array_compact(own))).alias("label"), "score")
    found = each.groupBy("label").agg(F.count(F.lit(1)).alias("all_count"), count_if(high()).alias("quality_count"))
    if seeded:
        spine = scores.sparkSession.createDataFrame([(x,) for x in seeded], "label string")
        found = found.join(F.broadcast(spine), "label", "full").na.fill(0, ["all_count", "quality_count"])
    rows = found.crossJoin(F.broadcast(whole)).select(  # one row of totals
        "label",
        "all_count",
        text.percent(F.col("all_count"), F.col("feeds")).alias("all_pct"),
        "quality_count",
        "quality_denominator",
        text.percent(F.col("quality_count"), F.col("quality_denominator")).alias("quality_pct"),
        text.percent(F.col("quality_count"), F.col("all_count")).alias("within_pct"),
    )
    rows = rows.orderBy(F.desc("all_count"), "label")
    return rows.limit(limit) if limit else rows


#: Names of what links tell about a feed.
SIGNALS = {"has_self_link": "self/canonical URL", "has_hub_link": "WebSub/PubSubHubbub hub", "has_paging_link": "paging links", "has_archive_link": "archive links"}


def signals() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(c), F.lit(name)) for c, name in SIGNALS.items())))


def extension_prevalence(scores: DataFrame, limit: int = 15) -> DataFrame:
    own = F.transform("extensions", lambda x: text.extension_label(x["ns"], x["local"]))
    rows = prevalence(scores, own, limit)
    return rows.withColumn("specification", text.specification(F.col("label")))


def profile_prevalence(scores: DataFrame) -> DataFrame:
    return prevalence(scores, F.array(_c("content_type_profile", "unknown")), seeded=content.PROFILES)


def language_prevalence(scores: DataFrame, limit: int = 20) -> DataFrame:
    own = strings("languages")
    return prevalence(scores, F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("unknown"))), limit)


def platform_prevalence(scores: DataFrame, limit: int = 15) -> DataFrame:
    own = strings("fingerprints")
    return prevalence(scores, F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("unknown"))), limit)


def signal_prevalence(scores: DataFrame) -> DataFrame:
    return prevalence(scores, signals(), seeded=tuple(SIGNALS.values()))


def latest(feeds: DataFrame, url: str = "url", order: tuple[str, ...] = ("request_time", "warc_path", "offset")) -> DataFrame:
    """One row for each URL: the latest by `order`. A maximum of structs, so that copies are dropped before the shuffle."""
    keys = [c for c in order if c in feeds.columns]
    rest = [c for c in feeds.columns if c not in (url, *keys)]
    kept = feeds.groupBy(url).agg(F.max_by(F.struct(*keys, *rest), F.struct(*keys)).alias("r"))
    return kept.select(url, "r.*").select(*feeds.columns)
