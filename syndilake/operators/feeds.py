"""Feed records: a parsed document and its response, joined by column expressions into one row of schema.FEEDS."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import content, dates, platforms, text
from ..functions.url import normalize_url, normalize_url_for_grouping
from .feed_parser import epoch, parsed

PAGING, ARCHIVE = ("first", "last", "next", "prev", "previous"), ("current", "next-archive", "prev-archive")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _rels(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys("parsed.feed_links"), F.array(*map(F.lit, names))), F.lit(False))


def answered(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def free_form_time(date: Column) -> Column:
    """A date in a free form, UTC if it names no zone; only dates that Spark can't read reach Python."""

    @F.pandas_udf("long")
    def seconds(texts: pd.Series) -> pd.Series:
        return pd.Series([epoch(x) for x in texts], dtype="Int64")

    return F.timestamp_seconds(seconds(F.when(F.try_to_timestamp(date).isNull(), date)))


def records(responses: DataFrame, now: Column) -> DataFrame:
    """One row of schema.FEEDS for each response: what its status, headers and bytes say. `now` stands in for a missing date.

    Bodies are cut at 10 MiB before Python sees them; a status outside 200 to 399 isn't parsed and gives no error.
    """
    body = F.when(answered(F.col("http_status")), F.substring("body", 1, content.FEED_BYTES))
    kept = responses.select("url", "http_status", "http_headers", "warc_date", "candidate_source", "error", "warc_path", "offset", body.alias("body"))
    rows = parsed(kept.withColumnRenamed("error", "read_error"))
    ok = answered(F.col("http_status"))
    read = F.col("read_error").isNull()
    valid = ok & read & F.col("parsed.error").isNull()
    p = lambda name: F.when(valid, F.col(f"parsed.{name}"))
    kind = platforms.header(F.col("http_headers"), "content-type")
    http_lang = F.lower(F.trim(F.substring_index(platforms.header(F.col("http_headers"), "content-language"), ",", 1)))
    at = dates.request_time(F.col("warc_date"), F.coalesce(free_form_time(F.col("warc_date")), now))
    links = F.transform(_list("parsed.entry_links"), lambda x: normalize_url_for_grouping(x))
    titles = F.transform(_list("parsed.entry_titles"), lambda x: text.entry_title(x))
    by_title, by_link = text.repeats(titles), text.repeats(links)
    newest, oldest, updated = (F.timestamp_seconds(p(c)) for c in ("newest", "oldest", "updated"))
    days = dates.cadence_days(newest, oldest, p("entries_count"))
    feed_lang = F.array_compact(F.array(p("lang_feed")))
    own = {
        "url": normalize_url(F.col("url")),
        "status": F.col("http_status"),
        "content_type": content.media_type(kind),
        "charset": content.charset(kind),
        "valid": F.coalesce(valid, F.lit(False)),
        "error": F.when(~read, F.col("read_error")).when(ok, F.col("parsed.error")),
        "error_type": F.when(~read, F.col("read_error")).when(ok, F.col("parsed.error_type")),
        "lang_http": F.when(valid & (http_lang != ""), http_lang),
        "link": F.when(p("link") != "", normalize_url(p("link"))),
        "languages": F.array_sort(F.array_union(feed_lang, F.coalesce(p("lang_entries"), F.array().cast("array<string>")))),
        "all_languages": F.array_sort(F.array_union(feed_lang, F.coalesce(p("all_languages"), F.array().cast("array<string>")))),
        "has_hreflang": F.coalesce(F.size(p("hreflang_values")) > 0, F.lit(False)),
        "content_type_profile": content.content_profile(p("content_types")),
        "fingerprints": F.array_sort(F.array_union(platforms.of_headers(F.col("http_headers")), platforms.of_value(p("feed_generator")))),
        "candidate_sources": F.array_compact(F.array("candidate_source")),
        "request_time": at,
        "updated_date": updated,
        "newest_entry_date": newest,
        "oldest_entry_date": oldest,
        "updated_recently": dates.recently(updated, at),
        "entry_recently": dates.recently(newest, at),
        "entry_title_count": by_title["n"],
        "repeated_entry_title_count": by_title["repeated"],
        "repeated_entry_title_ratio": by_title["ratio"],
        "default_entry_title_count": by_title["stock"],
        "entry_link_count": by_link["n"],
        "repeated_entry_link_count": by_link["repeated"],
        "repeated_entry_link_ratio": by_link["ratio"],
        "feed_link_rels": F.array_sort(F.map_keys(p("feed_links"))),
        "has_self_link": _rels("self"),
        "has_hub_link": _rels("hub"),
        "has_paging_link": _rels(*PAGING),
        "has_archive_link": _rels(*ARCHIVE),
        "update_cadence_days": F.round(days, 2),
        "update_cadence_bucket": dates.cadence_bucket(days),
    }
    columns = [own.get(f.name, p(f.name) if f.name in schema.PARSED.fieldNames() else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FEEDS.fields]
    return rows.select(*columns, "warc_path", "offset")
