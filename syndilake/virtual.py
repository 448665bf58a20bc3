"""Feeds, pages and links made of the test tables: the same text is run by Spark and, as a WITH clause, by DuckDB.

A user of `events` is a feed and an event an entry of it; `pages` have URLs of their own. Nothing is random.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all virtual crawls: 2024-03-01T00:00:00Z.
NOW = 1_709_251_200


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def strings(self) -> str:
        return "CAST(array() AS array<string>)" if self.spark else "CAST([] AS VARCHAR[])"

    def extension(self, ns: str, local: str) -> str:
        return f"named_struct('ns', '{ns}', 'local', {local})" if self.spark else f"{{'ns': '{ns}', 'local': {local}}}"


SPARK, DUCK = Dialect(True), Dialect(False)
SPARK_EPOCH, DUCK_EPOCH = "_epoch", "CAST(floor(epoch(ts)) AS BIGINT)"


def users(d: Dialect) -> str:
    ts = SPARK_EPOCH if d.spark else DUCK_EPOCH
    return f"SELECT user_id AS u, count(*) AS n, max({ts}) AS mx, min({ts}) AS mn FROM events GROUP BY user_id"


def feeds(d: Dialect) -> str:
    """Columns of schema.FEEDS that reports read, dates as seconds."""
    a = d.array
    dc, media, odd = "http://purl.org/dc/elements/1.1/", "http://search.yahoo.com/mrss/", "http://example.org/ns"
    return f"""SELECT concat('https://blog', u % 37, '.example', u % 5, '.org/feed/', u) AS url, u % 11 <> 0 AS valid,
  CASE WHEN u % 22 = 0 THEN concat('Unknown root tag: r', u % 46) WHEN u % 13 = 0 THEN 'mismatched tag: line 4, column 2' END AS error,
  CASE WHEN u % 44 = 0 THEN concat('Unknown root tag: r', u % 46) END AS error_type,
  CAST(CASE WHEN u % 33 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CASE u % 4 WHEN 0 THEN 'rss2.0' WHEN 1 THEN 'atom10' WHEN 2 THEN 'rss10' END AS format,
  CASE u % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN '' ELSE 'iso-8859-1' END AS charset,
  CASE WHEN u % 7 <> 0 THEN concat('  Feed  No ', u % 20) END AS title,
  CASE WHEN u % 6 <> 0 THEN concat('https://blog', u % 10, '.example.org/?p=', u) END AS link,
  CAST(CASE WHEN u % 12 = 0 THEN 0 ELSE n % 130 END AS INT) AS entries_count,
  u % 5 < 2 AS has_content, u % 5 < 4 AS has_summary,
  CASE u % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'plain' WHEN 2 THEN 'xhtml' WHEN 3 THEN 'mixed' WHEN 4 THEN 'unknown' END AS content_type_profile,
  CASE WHEN u % 5 = 0 THEN {a()} ELSE {a('CAST(n * 9 AS INT)', 'CAST(u * 31 % 2500 AS INT)')} END AS content_lengths,
  CASE u % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang_http,
  CASE u % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS lang_feed,
  CASE WHEN u % 5 = 0 THEN {a("'es'", "'en'")} ELSE {d.strings()} END AS lang_entries,
  CASE u % 3 WHEN 0 THEN {a("'en'")} WHEN 1 THEN {a("'fr'", "'es'")} ELSE {d.strings()} END AS languages,
  CASE u % 5 WHEN 0 THEN {a("'en'", "'es'", "'fr'", "'de'")} WHEN 1 THEN {a("'fr'")} WHEN 2 THEN {a("'fr'", "'en'")} ELSE {d.strings()} END AS all_languages,
  u % 8 = 0 AS has_hreflang, {d.strings()} AS hreflang_values,
  CASE u % 4 WHEN 0 THEN {a(d.extension(dc, "'creator'"), d.extension(media, "'content'"))} WHEN 1 THEN {a(d.extension(odd, "concat('x', u % 30)"))} WHEN 2 THEN {a(d.extension(dc, "'date'"))} END AS extensions,
  CASE u % 6 WHEN 0 THEN {a("'wordpress'")} WHEN 1 THEN {a("'ghost'", "'wordpress'")} ELSE {d.strings()} END AS fingerprints,
  CASE WHEN u % 4 = 1 THEN {a("'sniffed'")} ELSE {a("'feed_media_type'")} END AS candidate_sources,
  u % 2 = 0 AS has_self_link, u % 5 = 0 AS has_hub_link, u % 9 = 0 AS has_paging_link, u % 27 = 0 AS has_archive_link,
  CASE WHEN u % 19 <> 0 THEN mx - (u % 17) * 3456000 + CASE WHEN u % 23 = 0 THEN 5184000 ELSE 0 END END AS newest,
  CASE WHEN u % 19 <> 0 THEN mn - (u % 17) * 3456000 END AS oldest,
  CASE WHEN u % 3 <> 0 THEN mx - (u % 5) * 864000 END AS updated,
  CAST(CASE WHEN u % 12 = 0 THEN 0 ELSE 10 END AS INT) AS entry_title_count,
  CAST(u % 3 AS INT) AS repeated_entry_title_count, CAST(u % 11 AS DOUBLE) / 10 AS repeated_entry_title_ratio,
  CAST(CASE WHEN u % 9 = 0 THEN u % 7 ELSE 0 END AS INT) AS default_entry_title_count,
  CAST(u % 2 AS INT) AS repeated_entry_link_count, CAST(u % 13 AS DOUBLE) / 12 AS repeated_entry_link_ratio
FROM users"""


def links(d: Dialect) -> str:
    """A row for each event: a page announces the feed of the user, or of the one before if the user's number is odd."""
    a = d.array
    return f"""SELECT concat('https://www.site', event_id % 90, '.com/p/', event_id % 450) AS page_url, concat('site', event_id % 90, '.com') AS site,
  concat('https://blog', e % 37, '.example', e % 5, '.org/feed/', e) AS feed_url,
  CASE event_id % 7 WHEN 0 THEN {a("'feed'")} WHEN 1 THEN {a("'alternate'", "'feed'")} ELSE {a("'alternate'")} END AS rels,
  CASE event_id % 9 WHEN 0 THEN {a("'wordpress'")} WHEN 1 THEN {a("'ghost'", "'drupal'")} ELSE {d.strings()} END AS fingerprints
FROM (SELECT event_id, user_id - user_id % 2 AS e FROM events)"""


def announcing(d: Dialect) -> str:
    """Pages: url, fingerprints, has_links."""
    a = d.array
    return f"SELECT url, CASE page_id % 4 WHEN 0 THEN {a(chr(39) + 'wordpress' + chr(39))} WHEN 1 THEN {a(chr(39) + 'ghost' + chr(39), chr(39) + 'wordpress' + chr(39))} ELSE {d.strings()} END AS fingerprints, page_id % 3 = 0 AS has_links FROM pages"


#: Fixed values of the virtual headers.
HEADERS = ("text/html; charset=UTF-8", "application/rss+xml", "Application/Atom+XML; charset=\"utf-8\"", "text/xml; charset=iso-8859-1; x=1", "text/plain", "image/png", "application/xhtml+xml", "application/octet-stream", "text/rss;charset=a;charset=b", "")


def headers(d: Dialect) -> str:
    """Pages as responses: header, status, first bytes, payload type."""
    kind = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADERS))
    return f"""SELECT page_id, url, CASE page_id % 10 {kind} END AS header, CAST(CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CASE WHEN page_id % 19 = 0 THEN 'image/jpeg' WHEN page_id % 2 = 0 THEN 'application/xml' END AS payload_type,
  CASE WHEN page_id % 29 = 0 THEN 'request' ELSE 'response' END AS record_type,
  concat(CASE page_id % 6 WHEN 0 THEN '<RSS version="2.0">' WHEN 1 THEN '<feed xmlns="http://www.w3.org/2005/Atom">' WHEN 2 THEN '<rdf:RDF xmlns="http://purl.org/rss/1.0/">' WHEN 3 THEN '<feed>' ELSE '<p>' END, ' x') AS body
FROM pages"""


def sql(*names: str) -> str:
    """A WITH clause for DuckDB with the virtual tables that are named, and `users` before them."""
    made = {"feeds": feeds, "links": links, "announcing": announcing, "headers": headers}
    parts = [f"users AS ({users(DUCK)})"] + [f"v_{n} AS ({made[n](DUCK)})" for n in names]
    return "WITH " + ",\n".join(parts)


def _made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":  # whatever the session's zone
        seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        seconds = F.unix_seconds("ts")
    frames = {"events": events.withColumn("_epoch", seconds), "pages": spark.read.parquet(f"{sf_dir}/pages.parquet")}
    for name, frame in frames.items():
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: frame for name, frame in frames.items() if f"{{{name}}}" in text})


def feed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, feeds(SPARK).replace("FROM users", f"FROM ({users(SPARK)})"))
    dates = {"newest": "newest_entry_date", "oldest": "oldest_entry_date", "updated": "updated_date"}
    rows = rows.withColumns({name: F.timestamp_seconds(c) for c, name in dates.items()}).drop(*dates)
    return rows


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, links(SPARK))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, announcing(SPARK))


def header_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, headers(SPARK))
