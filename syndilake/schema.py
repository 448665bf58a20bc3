"""Types of the three fact tables and of what the parsers return; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()
_SS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: An HTTP response, from whatever source. `http_headers` has lower-case keys; `error` is set where reading failed,
#: `truncated` where the body had more bytes than were kept.
RESPONSES = _struct(
    record_type=_S, url=_S, warc_date=_S, payload_type=_S, http_status=_I, http_headers=T.MapType(_S, _S), body=T.BinaryType(),
    warc_path=_S, offset=_L, candidate_source=_S, error=_S, truncated=_B,
)
EXTENSION = _struct(ns=_S, local=_S)
#: What is read off the bytes of a feed; everything else is computed by column expressions.
PARSED = _struct(
    error=_S, error_type=_S, format=_S, entries_count=_I, title=_S, link=_S, feed_generator=_S, lang_feed=_S, lang_entries=_SS, all_languages=_SS,
    hreflang_values=_SS, has_summary=_B, has_content=_B, content_types=_SS, content_lengths=T.ArrayType(_I), extensions=T.ArrayType(EXTENSION),
    updated=_L, newest=_L, oldest=_L, entry_titles=_SS, entry_links=_SS, feed_links=T.MapType(_S, _I),
)
#: One row for each `<link>` that announces a feed.
LINK = _struct(feed_url=_S, rels=_SS, type=_S, title=_S, hreflang=_S)
OPML_ENTRY = _struct(feed_url=_S, html_url=_S, title=_S, pos=_I)
#: One row for each feed URL.
FEEDS = _struct(
    url=_S, status=_I, content_type=_S, charset=_S, valid=_B, error=_S, error_type=_S, format=_S, entries_count=_I, title=_S, link=_S,
    feed_generator=_S, lang_http=_S, lang_feed=_S, lang_entries=_SS, languages=_SS, all_languages=_SS, hreflang_values=_SS, has_hreflang=_B,
    has_summary=_B, has_content=_B, content_type_profile=_S, content_lengths=T.ArrayType(_I), extensions=T.ArrayType(EXTENSION), fingerprints=_SS,
    candidate_sources=_SS, request_time=_TS, updated_date=_TS, newest_entry_date=_TS, oldest_entry_date=_TS, updated_recently=_B, entry_recently=_B,
    entry_title_count=_I, repeated_entry_title_count=_I, repeated_entry_title_ratio=_D, default_entry_title_count=_I, entry_link_count=_I,
    repeated_entry_link_count=_I, repeated_entry_link_ratio=_D, feed_links=T.MapType(_S, _I), feed_link_rels=_SS, has_self_link=_B, has_hub_link=_B,
    has_paging_link=_B, has_archive_link=_B, update_cadence_days=_D, update_cadence_bucket=_S,
)
