"""Named queries over the test tables, and SQL written apart from them that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import virtual
from .functions import content, dates, platforms, text, url
from .operators import feeds, pages, routing, sites
from .plans import discovery, distributions, quality, sketches, timing
from .plans import feeds as reports
from .sources import lists
from .virtual import NOW, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now():  # noqa: ANN202
    return F.timestamp_seconds(F.lit(NOW))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.valid(virtual.feed_table(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_valid(spark, sf_dir), _now())


VALID = ", valid AS (SELECT * FROM v_feeds WHERE valid AND coalesce(error, '') = '')"
#: Scores in SQL: the sub-scores, then their sum in the same order, under the cap.
SCORES = f"""{VALID}, aged AS (SELECT *, CASE WHEN newest <= {NOW} + 86400 THEN greatest(0.0::DOUBLE, ({NOW} - newest) / 86400.0::DOUBLE) END AS na,
  CASE WHEN updated <= {NOW} + 86400 THEN greatest(0.0::DOUBLE, ({NOW} - updated) / 86400.0::DOUBLE) END AS ua FROM valid),
lively AS (SELECT *, coalesce(na, ua) AS age, coalesce(coalesce(na, ua) <= 365, false) AS active,
  default_entry_title_count / nullif(entry_title_count, 0)::DOUBLE AS stock0 FROM aged),
parts AS (SELECT *, coalesce(stock0, 0) AS stock,
  CASE WHEN active THEN pow(2.0::DOUBLE, -age / 120.0::DOUBLE) ELSE 0 END AS recency,
  CASE WHEN active THEN 0.5::DOUBLE * CASE WHEN has_content THEN 1.0::DOUBLE WHEN has_summary THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + 0.3::DOUBLE * CASE WHEN len(content_lengths) > 0 THEN least(list_sum(content_lengths)::DOUBLE / len(content_lengths) / 1000.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END
    + 0.2::DOUBLE * CASE WHEN content_type_profile IN ('html', 'xhtml') THEN 1.0::DOUBLE WHEN content_type_profile = 'mixed' THEN 0.75::DOUBLE WHEN content_type_profile = 'plain' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END
    ELSE 0.0::DOUBLE END AS content_richness,
  CASE WHEN active THEN least(entries_count / 20.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS entry_count,
  CASE WHEN active THEN least(greatest(CASE WHEN newest IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN oldest IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN len(lang_entries) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(content_lengths) > 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN repeated_entry_title_ratio >= 0.8::DOUBLE THEN 0.35::DOUBLE WHEN repeated_entry_title_ratio >= 0.5::DOUBLE THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN default_entry_title_count > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN repeated_entry_link_ratio >= 0.8::DOUBLE THEN 0.25::DOUBLE WHEN repeated_entry_link_ratio >= 0.5::DOUBLE THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS entry_metadata,
  CASE WHEN active THEN CASE WHEN coalesce(title, '') <> '' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(link, '') <> '' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN coalesce(lang_feed, '') <> '' OR coalesce(lang_http, '') <> '' OR len(all_languages) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN updated IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS feed_metadata FROM lively),
scores AS (SELECT *, CASE WHEN NOT active THEN 0.0::DOUBLE ELSE round(least(greatest(least(
    0.0::DOUBLE + 0.35::DOUBLE * recency + 0.25::DOUBLE * content_richness + 0.15::DOUBLE * entry_count + 0.15::DOUBLE * entry_metadata + 0.1::DOUBLE * feed_metadata,
    CASE WHEN repeated_entry_title_ratio >= 0.8::DOUBLE OR stock >= 0.5 THEN 0.55::DOUBLE WHEN repeated_entry_title_ratio >= 0.5::DOUBLE OR stock > 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END,
    CASE WHEN repeated_entry_link_ratio >= 0.8::DOUBLE THEN 0.65::DOUBLE WHEN repeated_entry_link_ratio >= 0.5::DOUBLE THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END,
    CASE WHEN (repeated_entry_title_ratio >= 0.8::DOUBLE OR stock >= 0.5) AND repeated_entry_link_ratio >= 0.8::DOUBLE THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END), 0.0::DOUBLE), 1.0::DOUBLE), 4) END AS score FROM parts)"""
COMPONENTS = tuple(quality.WEIGHTS)


# -- quality

@query(sql("feeds") + SCORES + " SELECT url, " + ", ".join(f"round({c}, 6) AS {c}" for c in COMPONENTS) + ", score, active FROM scores")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("url", *(F.round(f"components.{c}", 6).alias(c) for c in COMPONENTS), "score", "active")


@query(sql("feeds") + SCORES + """ SELECT coalesce(format, 'unknown') AS format, count(*) AS feeds, count(*) FILTER (score > 0.5) AS quality, round(avg(score), 6) AS mean,
  count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (score >= 0.4 AND score < 0.7) AS middle, count(*) FILTER (score < 0.4) AS low FROM scores GROUP BY 1""")
def quality_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_format(_scored(spark, sf_dir))


@query(sql("feeds") + SCORES + ", found AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n FROM scores GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN found ON bin = b")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(_scored(spark, sf_dir))


@query(sql("feeds") + SCORES + """ SELECT count(*) AS feeds, round(coalesce(avg(score), 0), 6) AS mean, count(*) FILTER (score > 0.5) AS quality, count(*) FILTER (active) AS active,
  round(coalesce(avg(score) FILTER (active), 0), 6) AS active_mean, count(*) FILTER (active AND entries_count > 0) AS active_with_entries, count(*) FILTER (age IS NULL) AS undated,
  count(*) FILTER (age IS NOT NULL AND NOT active) AS stale, """ + ", ".join(f"round(avg({c}) FILTER (active), 6) AS mean_{c}" for c in COMPONENTS) + " FROM scores")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_scored(spark, sf_dir))


@query(sql("feeds", "links") + SCORES + " SELECT url IN (SELECT feed_url FROM v_links) AS discovered, count(*) AS feeds, round(avg(score), 6) AS mean, count(*) FILTER (score > 0.5) AS quality FROM scores GROUP BY 1")
def quality_discovered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split(_scored(spark, sf_dir), virtual.link_table(spark, sf_dir))


# -- prevalence of labels

def _prevalence(labels: str, limit: int | None = None, seeded: tuple[str, ...] = (), more: str = "") -> str:
    spine = ("(SELECT unnest([" + ", ".join(f"'{x}'" for x in seeded) + "]) AS label) s FULL JOIN found USING (label)") if seeded else "found"
    return sql("feeds") + SCORES + f""", each AS (SELECT DISTINCT url, score, unnest({labels}) AS label FROM scores), whole AS (SELECT count(*) AS feeds, count(*) FILTER (score > 0.5) AS good FROM scores),
found AS (SELECT label, count(*) AS a, count(*) FILTER (score > 0.5) AS q FROM each WHERE label IS NOT NULL GROUP BY 1),
filled AS (SELECT label, coalesce(a, 0) AS a, coalesce(q, 0) AS q FROM {spine})
SELECT label, a AS all_count, CASE WHEN feeds > 0 THEN round(a / feeds * 100, 1) ELSE 0 END AS all_pct, q AS quality_count, good AS quality_denominator,
  CASE WHEN good > 0 THEN round(q / good * 100, 1) ELSE 0 END AS quality_pct, CASE WHEN a > 0 THEN round(q / a * 100, 1) ELSE 0 END AS within_pct {more}
FROM filled, whole ORDER BY a DESC, label""" + (f" LIMIT {limit}" if limit else "")


_OR_UNKNOWN = "CASE WHEN len({0}) > 0 THEN {0} ELSE ['unknown'] END"
_EXTENSION = "CASE x.ns WHEN 'http://purl.org/dc/elements/1.1/' THEN 'dc:' || x.local WHEN 'http://search.yahoo.com/mrss/' THEN 'media:' || x.local ELSE x.ns || '#' || x.local END"


@query(_prevalence(f"list_transform(extensions, lambda x: {_EXTENSION})", 15, more=""", CASE WHEN label LIKE 'dc:%' THEN 'https://www.dublincore.org/specifications/dublin-core/dces/'
  WHEN label LIKE 'media:%' THEN 'https://www.rssboard.org/media-rss' END AS specification"""))
def prevalence_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extension_prevalence(_scored(spark, sf_dir))


@query(_prevalence("[coalesce(content_type_profile, 'unknown')]", seeded=content.PROFILES))
def prevalence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile_prevalence(_scored(spark, sf_dir))


@query(_prevalence(_OR_UNKNOWN.format("languages"), 20))
def prevalence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.language_prevalence(_scored(spark, sf_dir))


@query(_prevalence(_OR_UNKNOWN.format("fingerprints"), 15))
def prevalence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.platform_prevalence(_scored(spark, sf_dir))


@query(_prevalence("[" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in reports.SIGNALS.items()) + "]", seeded=tuple(reports.SIGNALS.values())))
def prevalence_link_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.signal_prevalence(_scored(spark, sf_dir))


# -- totals of feeds

@query(sql("feeds") + VALID + """ SELECT count(*) AS feeds, count(*) FILTER (has_content) AS with_content, count(*) FILTER (NOT has_content AND has_summary) AS with_summary,
  count(*) FILTER (NOT has_content AND NOT has_summary) AS with_neither, coalesce(sum(entries_count), 0)::BIGINT AS entries, count(*) FILTER (entries_count > 0) AS with_entries,
  count(*) FILTER (entries_count > 0 AND newest IS NOT NULL) AS with_entry_dates, count(updated) AS with_updated_date, count(*) FILTER (repeated_entry_title_count > 0) AS with_repeated_titles,
  count(*) FILTER (default_entry_title_count > 0) AS with_stock_titles, count(*) FILTER (repeated_entry_link_count > 0) AS with_repeated_links,
  count(lang_http) AS lang_src_http, count(lang_feed) AS lang_src_feed, count(*) FILTER (len(lang_entries) > 0) AS lang_src_entry, count(*) FILTER (lang_http <> lang_feed) AS lang_mismatches,
  count(*) FILTER (len(all_languages) > 1) AS lang_multiple_in_feed, count(*) FILTER (lang_http IS NULL AND lang_feed IS NULL AND len(lang_entries) = 0 AND NOT has_hreflang) AS lang_no_info,
  count(*) FILTER (lang_http IS NOT NULL AND lang_feed IS NOT NULL) AS lang_http_feed, count(*) FILTER (has_hreflang) AS lang_hreflang,
  count(*) FILTER (len(list_distinct(CASE WHEN entries_count > 0 THEN list_concat(lang_entries, [lang_http, lang_feed]) ELSE lang_entries END)) > 1) AS lang_multiple_entry_languages FROM valid""")
def feed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(_valid(spark, sf_dir))


@query(sql("feeds") + VALID + " SELECT coalesce(format, 'unknown') AS format, CASE WHEN charset = '' THEN 'unknown' ELSE charset END AS charset, count(*) AS n FROM valid GROUP BY ALL")
def charset_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_charset(_valid(spark, sf_dir))


@query(sql("feeds") + VALID + f" SELECT unnest({_OR_UNKNOWN.format('languages')}) AS language, count(*) AS n FROM valid GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_language(_valid(spark, sf_dir))


@query(sql("feeds") + VALID + f", each AS (SELECT unnest(extensions) AS x FROM valid) SELECT {_EXTENSION} AS extension, count(*) AS n FROM each GROUP BY 1")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_extension(_valid(spark, sf_dir))


def _spined(labels: tuple[str, ...], name: str, found: str) -> str:
    return f"SELECT l AS {name}, coalesce(n, 0) AS n FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in labels) + f"]) AS l) LEFT JOIN ({found}) f ON f.k = l"


@query(sql("feeds") + VALID + " " + _spined(content.PROFILES, "profile", "SELECT coalesce(content_type_profile, 'unknown') AS k, count(*) AS n FROM valid GROUP BY 1"))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_profile(_valid(spark, sf_dir))


@query(sql("feeds") + VALID + " " + _spined(("0", "1", "2", "3+"), "languages", "SELECT CASE WHEN len(all_languages) > 2 THEN '3+' ELSE len(all_languages)::VARCHAR END AS k, count(*) AS n FROM valid GROUP BY 1"))
def language_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_language_count(_valid(spark, sf_dir))


@query(sql("feeds") + VALID + """ SELECT (SELECT count(*) FROM v_feeds) AS feeds, count(*) AS parsed, (SELECT count(*) FROM v_feeds) - count(*) AS unparsed,
  count(*) FILTER (format LIKE 'rss%') AS rss, count(*) FILTER (format LIKE 'atom%') AS atom FROM valid""")
def format_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.families(virtual.feed_table(spark, sf_dir))


@query(sql("feeds") + VALID + " " + _spined(("rss", "atom", "other"), "family", """SELECT CASE WHEN format LIKE 'rss%' OR format LIKE 'rdf%' THEN 'rss' WHEN format LIKE 'atom%' THEN 'atom' ELSE 'other' END AS k,
  count(*) AS n FROM valid WHERE list_contains(candidate_sources, 'sniffed') GROUP BY 1"""))
def sniffed_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sniffed(virtual.feed_table(spark, sf_dir))


_ERRORS = sql("feeds") + VALID + """, bad AS (SELECT CASE WHEN coalesce(error_type, '') <> '' THEN error_type WHEN error LIKE 'mismatched%' THEN 'mismatched tag' WHEN error IS NOT NULL THEN error
  ELSE 'HTTP ' || status END AS label FROM v_feeds WHERE NOT (valid AND coalesce(error, '') = '')), counted AS (SELECT label, count(*) AS n, label LIKE 'Unknown root tag: %' AS root FROM bad GROUP BY 1),
placed AS (SELECT *, root AND row_number() OVER (PARTITION BY root ORDER BY n DESC, label) > 15 AS folded FROM counted)
SELECT CASE WHEN folded THEN 'Other unknown root tags' ELSE label END AS label, sum(n)::BIGINT AS n, folded FROM placed GROUP BY 1, 3"""


@query(_ERRORS)
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.errors(virtual.feed_table(spark, sf_dir))


@query(sql("feeds") + VALID + " SELECT count(DISTINCT regexp_extract(url, '([^./]+[.]org)/', 1)) AS sites FROM valid")
def sites_with_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sites(_valid(spark, sf_dir))


# -- distributions

def _binned(bins: list, rows: str, value: str, weight: str = "count(*)") -> str:
    case = " ".join("WHEN TRUE THEN " + str(k) if most is None else f"WHEN {value} <= {most} THEN {k}" for k, (most, _) in enumerate(bins))
    spine = ", ".join(f"({k}, '{label}')" for k, (_, label) in enumerate(bins))
    return f"SELECT place::INT AS place, label, coalesce(n, 0)::BIGINT AS n FROM (VALUES {spine}) s(place, label) LEFT JOIN (SELECT CASE {case} END AS k, {weight} AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1) f ON f.k = place"


def _cumulative(points: list, rows: str, value: str) -> str:
    one = " UNION ALL ".join(f"SELECT {k} AS place, '{label}' AS label, count(*) FILTER ({value} <= {p}) AS n, count({value}) AS known, count(*) - count({value}) AS missing FROM {rows}" for k, (p, label) in enumerate(points))
    return f"SELECT place::INT AS place, label, n, known, CASE WHEN known > 0 THEN round(n / known * 100, 1) ELSE 0 END AS pct, missing FROM ({one})"


@query(sql("feeds") + VALID + f", a AS (SELECT CASE WHEN newest <= {NOW} + 86400 THEN floor(greatest(0, ({NOW} - newest) / 86400.0::DOUBLE)) END AS age FROM valid) " + _cumulative(distributions.RECENCY, "a", "age"))
def recency_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.recency(_valid(spark, sf_dir), "newest_entry_date", _now())


_CADENCE = ", c AS (SELECT *, CASE WHEN entries_count > 1 AND newest > oldest THEN (newest - oldest) / 86400.0::DOUBLE / (entries_count - 1) END AS days FROM valid)"


def _cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dates.cadence_days(F.col("newest_entry_date"), F.col("oldest_entry_date"), F.col("entries_count"))
    return _valid(spark, sf_dir).withColumns({"update_cadence_days": F.round(days, 2), "update_cadence_bucket": dates.cadence_bucket(days)})


@query(sql("feeds") + VALID + _CADENCE + " " + _cumulative(distributions.CADENCE, "(SELECT round(days, 2) AS days FROM c)", "days"))
def cadence_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.cadence(_cadence(spark, sf_dir))


@query(sql("feeds") + VALID + _CADENCE + """ SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days < 1 THEN 'sub-daily' WHEN days < 2 THEN 'daily' WHEN days < 8 THEN 'weekly' WHEN days < 32 THEN 'monthly'
  ELSE 'slower' END AS update_cadence_bucket, count(*) AS n FROM c GROUP BY 1""")
def cadence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(_cadence(spark, sf_dir), F.col("update_cadence_bucket"), "update_cadence_bucket")


@query(sql("feeds") + f" SELECT url, coalesce({NOW} - 2592000 - updated BETWEEN 0 AND 604799, false) AS updated_recently, coalesce({NOW} - 2592000 - newest BETWEEN 0 AND 604799, false) AS entry_recently FROM v_feeds")
def recent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(NOW - 30 * dates.DAY))
    return virtual.feed_table(spark, sf_dir).select("url", dates.recently(F.col("updated_date"), at).alias("updated_recently"), dates.recently(F.col("newest_entry_date"), at).alias("entry_recently"))


@query(sql("feeds") + " " + _binned(distributions.ENTRIES, "v_feeds", "entries_count"))
def entry_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.entry_histogram(virtual.feed_table(spark, sf_dir), "entries_count")


@query(_binned(distributions.LOG, "documents", "n_chars"))
def hist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.log_histogram(_read(spark, sf_dir, "documents"), "n_chars")


@query("""WITH most AS (SELECT greatest(1023, max(n_chars)) AS m FROM documents), bins AS (SELECT * FROM (VALUES (0, 0, '0'), (1, 127, '-127'), (2, 254, '-254'), (3, 511, '-511'), (4, 1023, '-1023')) b(place, top, label)
  UNION ALL SELECT 5 + k, 2 * 1024 * 2 ** k - 1, '-' || (2 * 2 ** k)::BIGINT || 'k' FROM range(40) t(k), most WHERE 1024 * 2 ** k <= m),
placed AS (SELECT (SELECT min(place) FROM bins WHERE top >= n_chars) AS place FROM documents)
SELECT b.place::INT AS place, label, count(p.place) AS n FROM bins b LEFT JOIN placed p ON p.place = b.place GROUP BY 1, 2""")
def hist_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.natural_histogram(_read(spark, sf_dir, "documents"), "n_chars")


@query("""WITH w AS (SELECT greatest(1, max(p_size) // 10) AS w FROM part), b AS (SELECT p_size // w * w AS low, p_size // w * w + w - 1 AS high FROM part, w)
SELECT low::BIGINT AS low, CASE WHEN low = high THEN low::VARCHAR WHEN high >= 1024 THEN '-' || high // 1024 || 'k' ELSE '-' || high END AS label, count(*) AS n FROM b GROUP BY 1, 2""")
def hist_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.simple_histogram(_read(spark, sf_dir, "part"), "p_size")


@query(sql("feeds") + " SELECT (v // 100 * 100)::INT AS bin, count(*) AS n FROM (SELECT unnest(content_lengths) AS v FROM v_feeds) GROUP BY 1")
def length_hist_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.hundreds(virtual.feed_table(spark, sf_dir))


# -- discovery

_TOKENS = ", t AS (SELECT page_url, feed_url, list_sort(list_distinct(flatten(list(rels)))) AS rels FROM v_links GROUP BY 1, 2), per AS (SELECT page_url, count(*) AS feeds, bool_or(list_contains(rels, 'alternate')) AS a, bool_or(list_contains(rels, 'feed')) AS f, count(*) FILTER (len(rels) > 1) AS b FROM t GROUP BY 1)"


@query(sql("links") + _TOKENS + " SELECT count(*) AS pages, count(*) FILTER (a) AS rel_alternate, count(*) FILTER (f) AS rel_feed, count(*) FILTER (a AND f) AS rel_both, coalesce(sum(b), 0)::BIGINT AS links_both, count(*) FILTER (b > 0) AS pages_links_both FROM per")
def discovery_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.page_totals(virtual.link_table(spark, sf_dir))


@query(sql("links") + _TOKENS + " SELECT * FROM (" + _binned(distributions.DISCOVERY, "per", "feeds") + ") WHERE label <> '0'")
def links_per_page_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.links_per_page(virtual.link_table(spark, sf_dir))


@query(sql("links") + ", s AS (SELECT site, count(DISTINCT feed_url) AS feeds FROM v_links GROUP BY 1) SELECT * FROM (" + _binned(distributions.DISCOVERY, "s", "feeds") + ") WHERE label <> '0'")
def feeds_per_site_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.feeds_per_site(virtual.link_table(spark, sf_dir))


@query(sql("feeds", "links") + " SELECT url, coalesce(links, 0) AS links, coalesce(sites, 0) AS sites FROM v_feeds LEFT JOIN (SELECT feed_url, count(*) AS links, count(DISTINCT site) AS sites FROM v_links GROUP BY 1) ON feed_url = url")
def feed_discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.with_counts(virtual.feed_table(spark, sf_dir), virtual.link_table(spark, sf_dir)).select("url", "links", "sites")


_SOURCES = ", each AS (SELECT DISTINCT page_url, feed_url, unnest(CASE WHEN len(fingerprints) > 0 THEN fingerprints ELSE ['unknown'] END) AS label FROM v_links), sources AS (SELECT feed_url, label, count(*) AS n FROM each GROUP BY 1, 2)"


@query(sql("links") + _SOURCES + " SELECT * FROM sources")
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.sources(virtual.link_table(spark, sf_dir))


@query(sql("feeds", "links") + SCORES + _SOURCES + """, own AS (SELECT score, coalesce(label, 'unknown') AS label FROM scores LEFT JOIN (SELECT DISTINCT feed_url, label FROM sources) ON feed_url = url),
r AS (SELECT label, count(*) AS feeds, count(*) FILTER (score > 0.5) AS quality, round(avg(score), 6) AS mean FROM own GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY feeds DESC, label) AS k FROM r)
SELECT label, feeds, quality, mean FROM p WHERE k <= 2 OR label = 'unknown' ORDER BY (label <> 'unknown' AND k = 2), k LIMIT 2""")
def source_fp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = discovery.sources(virtual.link_table(spark, sf_dir))
    return discovery.source_quality(_scored(spark, sf_dir), own, limit=2)


@query(sql("announcing") + """, rows_ AS (SELECT unnest(fingerprints) AS label, has_links FROM v_announcing), r AS (SELECT label, count(*) AS pages, count(*) FILTER (has_links) AS auto_pages FROM rows_ GROUP BY 1
  UNION ALL SELECT 'unknown', count(*) FILTER (len(fingerprints) = 0), count(*) FILTER (len(fingerprints) = 0 AND has_links) FROM v_announcing)
SELECT label, pages, auto_pages, CASE WHEN pages > 0 THEN round(auto_pages / pages * 100, 1) ELSE 0 END AS pct FROM r""")
def html_fingerprint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.platform_table(virtual.page_table(spark, sf_dir))


@query(sql("links") + f" SELECT page_url, list_sort(list(DISTINCT feed_url)) AS feeds FROM v_links GROUP BY 1 HAVING count(DISTINCT feed_url) > 1 ORDER BY md5(page_url), page_url LIMIT {discovery.SAMPLE}")
def multi_feed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.several(virtual.link_table(spark, sf_dir), limit=discovery.SAMPLE)


#: Feeds with few titles and links, so that pages have copies.
_COPIES = """, v AS (SELECT url, CASE WHEN u3 = 0 THEN NULL ELSE 'https://h.example.org/' || u3 END AS link, 'a ' || u5 AS title, coalesce(format, 'unknown') AS format
  FROM (SELECT *, regexp_extract(url, '([0-9]+)$', 1)::INT % 3 AS u3, regexp_extract(url, '([0-9]+)$', 1)::INT % 5 AS u5 FROM v_feeds)),
multi AS (SELECT page_url FROM v_links GROUP BY 1 HAVING count(DISTINCT feed_url) > 1), each AS (SELECT DISTINCT page_url, feed_url FROM v_links JOIN multi USING (page_url)),
same AS (SELECT page_url, link, title, count(*) AS copies, list(format) AS formats FROM each JOIN v ON url = feed_url GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = F.regexp_extract("url", "([0-9]+)$", 1).cast("int")
    own = virtual.feed_table(spark, sf_dir).select("url", F.when(u % 3 != 0, F.concat(F.lit("HTTPS://H.example.org/"), (u % 3).cast("string"), F.lit("/?q="), u.cast("string"))).alias("link"), F.concat(F.lit(" A  "), (u % 5).cast("string")).alias("title"), "format")
    return discovery.several(virtual.link_table(spark, sf_dir)), own


@query(sql("feeds", "links") + _COPIES + " SELECT page_url, (sum(copies) - count(*))::BIGINT AS extra FROM same GROUP BY 1")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.duplicate_pages(*_copies(spark, sf_dir))


@query(sql("feeds", "links") + _COPIES + """, f AS (SELECT row_number() OVER () AS g, formats FROM same), e AS (SELECT g, unnest(formats) AS f FROM f), n AS (SELECT g, f, row_number() OVER (PARTITION BY g ORDER BY f) AS k FROM e)
SELECT a.f || ' and ' || b.f AS pair, count(*) AS n FROM n a JOIN n b ON a.g = b.g AND a.k < b.k GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""")
def duplicate_format_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.format_pairs(*_copies(spark, sf_dir))


@query(sql("feeds", "links") + _COPIES + """ SELECT (SELECT count(DISTINCT page_url) FROM v_links) AS pages, greatest(0, 100000 - (SELECT count(DISTINCT page_url) FROM v_links)) AS zero_pages, (SELECT count(DISTINCT site) FROM v_links) AS sites,
  greatest(0, 200 - (SELECT count(DISTINCT site) FROM v_links)) AS zero_sites, (SELECT count(*) FROM multi) AS several, (SELECT count(DISTINCT page_url) FROM same) AS duplicate_pages,
  round((SELECT count(DISTINCT page_url) FROM same) / (SELECT count(*) FROM multi) * 100, 1) AS duplicate_pct""")
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.summary(virtual.link_table(spark, sf_dir), 100_000, 200, *_copies(spark, sf_dir))


@query(sql("feeds", "links") + " SELECT url FROM v_feeds WHERE url NOT IN (SELECT feed_url FROM v_links)")
def undiscovered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = virtual.link_table(spark, sf_dir).select(F.col("feed_url").alias("url")).distinct()
    return virtual.feed_table(spark, sf_dir).select("url").join(known, "url", "left_anti")


# -- URLs, media types and routing

_PARTS = "lower(regexp_extract(v, '^([A-Za-z]+):', 1)) AS s, lower(regexp_extract(v, '^[A-Za-z]+://([^/?#]*)', 1)) AS a, regexp_extract(v, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(v, '[?]([^#]*)', 1) AS q"


@query(f"""WITH v AS (SELECT page_id, CASE page_id % 3 WHEN 1 THEN replace(url, 'http', 'HTTP') WHEN 2 THEN '  ' || url || ' ' ELSE url END AS v0 FROM pages), t AS (SELECT page_id, trim(v0) AS v FROM v), x AS (SELECT page_id, {_PARTS} FROM t),
y AS (SELECT *, CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END AS path FROM x) SELECT page_id, s || '://' || a || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normal, s || '://' || a || path AS grouped FROM y""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http"), F.lit("HTTP"))).when(F.col("page_id") % 3 == 2, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", url.normalize_url(raw).alias("normal"), url.normalize_url_for_grouping(raw).alias("grouped"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1) AS site FROM pages")
def url_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"), url.site(F.col("url")).alias("site"))


#: Hosts with ports, users, addresses, and suffixes that are long, wild, exempt or unknown: a URL, its host and its site, by a number.
_HOSTS = (
    ("https://Blog%s.Example.co.uk:8080/x", "blog%s.example.co.uk", "example.co.uk"), ("http://user:pw@a.b%s.github.io/", "a.b%s.github.io", "b%s.github.io"), ("https://b%s.github.io", "b%s.github.io", "b%s.github.io"),
    ("https://github.io/%s", "github.io", "github.io"), ("http://x.y%s.unknownsuffix/?q#f", "x.y%s.unknownsuffix", "y%s.unknownsuffix"), ("https://www.w%s.anything.ck/", "www.w%s.anything.ck", "w%s.anything.ck"),
    ("https://a.www.ck/%s", "a.www.ck", "www.ck"), ("http://city.kawasaki.jp/%s", "city.kawasaki.jp", "city.kawasaki.jp"), ("http://s.t%s.ward.kawasaki.jp/", "s.t%s.ward.kawasaki.jp", "t%s.ward.kawasaki.jp"),
    ("http://10.0.0.%s:81/", "10.0.0.%s", "10.0.0.%s"), ("http://[2001:db8::%s]:81/", "2001:db8::%s", "2001:db8::%s"), ("plain%s.example.com/path", "plain%s.example.com", "example.com"), ("https://deep.er.s%s.example.com.au./", "deep.er.s%s.example.com.au.", "example.com.au"),
)
_NUMBERED = lambda text: "'" + text.replace("%s", "' || (page_id % 200) || '") + "'"
_HOSTS_SQL = "SELECT page_id, " + ", ".join(f"CASE page_id % {len(_HOSTS)} " + " ".join(f"WHEN {k} THEN {_NUMBERED(h[c])}" for k, h in enumerate(_HOSTS)) + f" END AS {name}" for c, name in ((1, "host"), (2, "site"))) + " FROM pages"


def _hard_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % len(_HOSTS)
    out = F.lit(None).cast("string")
    for n, (made, _, _) in enumerate(_HOSTS):
        out = F.when(k == n, F.format_string(made, (F.col("page_id") % 200).cast("string"))).otherwise(out)
    return _read(spark, sf_dir, "pages").select("page_id", out.alias("url"))


@query(_HOSTS_SQL)
def url_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hard_urls(spark, sf_dir).select("page_id", url.host(F.col("url")).alias("host"), url.site(F.col("url")).alias("site"))


@query(_HOSTS_SQL)
def url_site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.with_site(_hard_urls(spark, sf_dir), F.col("url"), sites.suffix_table(spark)).select("page_id", url.host(F.col("url")).alias("host"), "site")


_VALUES = {"WordPress 6.4; https://wp.com": ["wordpress"], "Ghost/5": ["ghost"], "xghosty": [], "a blogspot Blogger": ["blogger"], "x.wp.com.y": ["wordpress"], "Drupal 9 (https://drupal.org) + Substack!": ["drupal", "substack"], "": []}


@query("SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{' '.join(v)}'" for k, v in enumerate(_VALUES.values())) + " END AS of_value, CASE WHEN page_id % 2 = 1 THEN '' ELSE CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{' '.join(v)}'" for k, v in enumerate(_VALUES.values())) + """ END END AS of_headers,
  CASE WHEN contains(html, '<') AND contains(html, '>') THEN 'html' ELSE 'plain' END AS of_html, CASE WHEN contains(url, '<') AND contains(url, '>') THEN 'html' ELSE 'plain' END AS of_url,
  CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'xhtml' WHEN 2 THEN 'plain' WHEN 3 THEN 'html' ELSE 'plain' END AS of_type FROM pages""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms of values and of headers; kinds of text, and of type attributes."""
    value = F.get(F.array(*map(F.lit, _VALUES)), (F.col("page_id") % 7).cast("int"))
    named = F.create_map(F.when(F.col("page_id") % 2 == 0, "x-generator").otherwise("x-other"), value)
    kind = F.get(F.array(F.lit(" HTML "), F.lit("application/XHTML+xml"), F.lit("text"), F.lit("text/html"), F.lit(None)), (F.col("page_id") % 5).cast("int"))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(platforms.of_value(value), " ").alias("of_value"), F.array_join(platforms.of_headers(named), " ").alias("of_headers"),
                                                content.text_content_type(F.col("html")).alias("of_html"), content.text_content_type(F.col("url")).alias("of_url"), content.atom_content_type(kind).alias("of_type"))


@query(sql("headers") + """, k AS (SELECT *, trim(split_part(lower(header), ';', 1)) AS kind FROM v_headers) SELECT page_id, kind AS media_type, trim(replace(coalesce(list_extract(regexp_extract_all(lower(header), ';\\s*charset=([^;]*)', 1), -1), ''), '"', '')) AS charset,
  kind IN ('application/rss+xml', 'application/atom+xml', 'application/xml+rss', 'text/rss', 'text/atom') OR kind LIKE '%+rss' OR kind LIKE '%+atom' AS is_feed,
  kind LIKE '%xml%' OR kind LIKE '%text/plain%' OR kind LIKE '%application/octet-stream%' AS is_sniffable,
  lower(header) LIKE '%text/html%' OR lower(header) LIKE '%xml%' OR lower(header) LIKE '%rss%' OR lower(header) LIKE '%text/plain%' OR lower(header) LIKE '%application/octet-stream%' AS is_interesting FROM k""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, kind = F.col("header"), content.media_type(F.col("header"))
    return virtual.header_table(spark, sf_dir).select("page_id", kind.alias("media_type"), content.charset(header).alias("charset"), content.is_feed_type(kind).alias("is_feed"), content.is_sniffable(kind).alias("is_sniffable"), content.is_interesting(header).alias("is_interesting"))


@query(sql("headers") + ", k AS (SELECT trim(split_part(lower(header), ';', 1)) AS k FROM v_headers WHERE header <> '') " + _spined(content.COLLAPSED, "class", """SELECT CASE WHEN k LIKE '%text/html%' OR k LIKE '%application/xhtml%' THEN 'HTML' WHEN k LIKE '%atom%' THEN 'Atom'
  WHEN k LIKE '%rss%' THEN 'RSS' WHEN k LIKE '%xml%' THEN 'Other XML' ELSE 'Other Non-XML' END AS k, count(*) AS n FROM k GROUP BY 1"""))
def content_type_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_content_type(virtual.header_table(spark, sf_dir).select(content.media_type(F.col("header")).alias("content_type")))


_SNIFF = "CASE page_id % 6 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'rdf' ELSE 'unknown' END"


@query(f"SELECT page_id, {_SNIFF} AS format FROM pages")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.header_table(spark, sf_dir).select("page_id", content.sniff(F.col("body").cast("binary")).alias("format"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = virtual.header_table(spark, sf_dir)
    return rows.select("page_id", "record_type", "url", F.lit("2024-02-01T00:00:00Z").alias("warc_date"), "payload_type", F.col("status").alias("http_status"), F.create_map(F.lit("content-type"), "header").alias("http_headers"), F.col("body").cast("binary").alias("body"))


_ROUTES = sql("headers") + f""", k AS (SELECT *, lower(header) AS h, trim(split_part(lower(header), ';', 1)) AS kind, {_SNIFF} AS sniff FROM v_headers),
j AS (SELECT *, record_type = 'response' AND (payload_type IS NULL OR payload_type LIKE '%xml%') AND (h LIKE '%text/html%' OR h LIKE '%xml%' OR h LIKE '%rss%' OR h LIKE '%text/plain%' OR h LIKE '%application/octet-stream%') AS page,
  kind IN ('application/rss+xml', 'application/atom+xml', 'text/rss') AS feed FROM k),
routed AS (SELECT page_id, CASE WHEN NOT page THEN 'dropped' WHEN kind = 'text/html' THEN 'html' WHEN status = 200 AND feed THEN 'feed'
  WHEN status = 200 AND (kind LIKE '%xml%' OR kind IN ('text/plain', 'application/octet-stream')) AND sniff <> 'unknown' THEN 'sniffed' ELSE 'none' END AS route FROM j)"""


@query(_ROUTES + " SELECT * FROM routed")
def route_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(_responses(spark, sf_dir)).select("page_id", "route")


@query(_ROUTES + """ SELECT count(*) FILTER (record_type = 'response') AS responses_processed, count(*) FILTER (route <> 'dropped') AS pages_processed, count(*) FILTER (route = 'html') AS html_pages,
  count(*) FILTER (route = 'feed') AS feed_responses, count(*) FILTER (route = 'sniffed') AS feeds_sniffed,
  count(DISTINCT regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1)) FILTER (route <> 'dropped') AS sites,
  max('2024-02-01T00:00:00Z') FILTER (route <> 'dropped') AS max_crawl_time FROM routed JOIN v_headers USING (page_id)""")
def route_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.counters(routing.routed(_responses(spark, sf_dir)))


@query(_ROUTES + " SELECT route, count(*) AS n FROM routed GROUP BY 1")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(routing.routed(_responses(spark, sf_dir)), F.col("route"), "route")


@query("SELECT page_id FROM pages WHERE regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1) IN (SELECT regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1) FROM pages WHERE url LIKE 'https:%')")
def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir)
    top = _read(spark, sf_dir, "pages").filter("url LIKE 'https:%'").select(url.site(F.col("url")).alias("site"))
    return routing.scoped(rows, top).select("page_id")


_SITE_SQL = "regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1)"


@query(f"SELECT count(DISTINCT {_SITE_SQL}) AS sites FROM pages")
def sites_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.exact(_read(spark, sf_dir, "pages").select(url.site(F.col("url")).alias("site")))


#: CRC-32 by its table, which follows from the polynomial.
_CRC = """WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS s FROM pages), b AS (SELECT s, list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT) AS bytes FROM h WHERE s <> ''),
c AS (SELECT s, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM b, t),
r AS (SELECT crc & 4095 AS register, max(CASE WHEN crc >> 12 = 0 THEN 21 ELSE 21 - length(ltrim(bin(crc >> 12), '0')) END) AS rho FROM c GROUP BY 1),
e AS (SELECT count(*) AS k, coalesce(sum(pow(2.0, -rho)), 0) AS s FROM r), w AS (SELECT 4096 - k AS empty, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (s + 4096 - k) AS raw FROM e)
SELECT floor(CASE WHEN raw <= 10240 AND empty > 0 THEN 4096 * ln(4096 / empty::DOUBLE) ELSE raw END)::BIGINT AS sites FROM w"""


@query(_CRC)
def sites_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.estimate(sketches.registers(_read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("site"))))


@query()
def sites_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.approximate(_read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("site")))


@query("SELECT user_id::VARCHAR AS url, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("request_time"), F.col("event_id").alias("offset"))
    return reports.latest(rows).select("url", F.col("offset").alias("event_id"))


@query("""WITH t AS (SELECT o_custkey AS k, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1, 2) SELECT k AS custkey, sum(c)::INT AS n, coalesce(sum(c) FILTER (c > 1), 0)::INT AS repeated,
  round(coalesce(sum(c) FILTER (c > 1), 0) / sum(c), 4) AS ratio FROM t GROUP BY 1""")
def entry_title_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.collect_list(text.entry_title(F.col("o_orderpriority"))).alias("t"))
    r = text.repeats(F.col("t"))
    return titles.select("custkey", r["n"].alias("n"), r["repeated"].alias("repeated"), r["ratio"].alias("ratio"))


@query("""WITH s AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders), r AS (SELECT ms, row_number() OVER (ORDER BY ms) AS k, count(*) OVER () AS n FROM s)
SELECT 'ms' AS metric, count(ms) AS n, sum(ms)::BIGINT AS total, round(avg(ms), 3) AS mean, quantile_cont(ms, 0.5) AS median, (SELECT min(ms) FROM r WHERE k >= greatest(1, floor(n * 90 / 100))) AS p90, max(ms) AS longest FROM s""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.metric(_read(spark, sf_dir, "orders").select(F.floor("o_totalprice").cast("long").alias("ms")), "ms")


# -- parsers: documents made of the tables, parsed, and held against the tables

_WITH_ENTRIES = "SELECT user_id AS u, count(*) AS entries, max(CAST(floor(epoch(ts)) AS BIGINT)) AS newest, min(CAST(floor(epoch(ts)) AS BIGINT)) AS oldest, sum(length(event_type) + 4)::BIGINT AS characters FROM events GROUP BY 1"
_DOCUMENTS = {
    "rss": ('<rss version="2.0"><channel><title>Feed %s</title><link>http://h.example.org/%s</link><language>DE</language>', "<item><title>%s</title><pubDate>%s</pubDate><description>%s and</description></item>", "</channel></rss>"),
    "atom": ('<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="DE"><title>Feed %s</title><link href="http://h.example.org/%s"/>', "<entry><title>%s</title><updated>%s</updated><summary>%s and</summary></entry>", "</feed>"),
    "rdf": ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xml:lang="DE"><channel><title>Feed %s</title><link>http://h.example.org/%s</link></channel>',
            "<item><title>%s</title><dc:date>%s</dc:date><description>%s and</description></item>", "</rdf:RDF>"),
}


def _documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    head, entry, tail = _DOCUMENTS[kind]
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    events = _read(spark, sf_dir, "events").withColumn("one", F.format_string(entry, "event_type", ts, "event_type"))
    docs = events.groupBy(F.col("user_id").alias("u")).agg(F.array_join(F.collect_list("one"), "").alias("items"))
    whole = F.concat(F.format_string(head, F.col("u").cast("string"), F.col("u").cast("string")), "items", F.lit(tail))
    headers = F.create_map(F.lit("content-type"), F.lit("application/xml; charset=UTF-8"))
    return docs.select("u", F.concat(F.lit("http://h.example.org/f/"), F.col("u").cast("string")).alias("url"), F.lit(200).alias("http_status"), headers.alias("http_headers"), F.lit("2024-02-01T00:00:00Z").alias("warc_date"),
                       F.lit("feed_media_type").alias("candidate_source"), F.lit(None).cast("string").alias("error"), F.lit("").alias("warc_path"), F.lit(0).cast("long").alias("offset"), whole.cast("binary").alias("body"))


def _round_trip(kind: str, form: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the session's zone writes the dates and reads them back, so it is the same one: UTC
        zone = spark.conf.get("spark.sql.session.timeZone")
        shift = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.lit(0)), zone)) if zone not in ("UTC", "Etc/UTC") else F.lit(0)
        rows = feeds.records(_documents(spark, sf_dir, kind), _now())
        total = F.aggregate("content_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        return rows.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("u"), "valid", "format", "title", "link", "lang_feed", F.col("entries_count").cast("long").alias("entries"),
                           (F.unix_seconds("newest_entry_date") + shift).alias("newest"), (F.unix_seconds("oldest_entry_date") + shift).alias("oldest"), total.alias("characters"), "content_type_profile")

    QUERIES[f"parse_roundtrip_{kind}"] = run
    SQL[f"parse_roundtrip_{kind}"] = f"WITH e AS ({_WITH_ENTRIES}) SELECT u, true AS valid, '{form}' AS format, 'Feed ' || u AS title, 'http://h.example.org/' || u AS link, 'de' AS lang_feed, entries, newest, oldest, characters, 'plain' AS content_type_profile FROM e"


for _kind, _form in (("rss", "rss2.0"), ("atom", "atom10"), ("rdf", "rss10")):
    _round_trip(_kind, _form)


_RSS = '<rss version="2.0"><channel><title>%s</title></channel></rss>'


def _declared(name: str, title: str) -> tuple[bytes, int, str]:
    """A feed whose title is in an encoding that it declares."""
    return f'<?xml version="1.0" encoding="{name}"?>{_RSS}'.replace("%s", title).encode(name), 200, f"true, NULL, '{title}', 'rss2.0', 0, 'unknown'"


_ATOM = '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en"><title>t</title>%s</feed>'
#: Documents, their status, and what is to be read of them: valid, error_type, title, format, entries, profile.
_VARIED = (
    _declared("Shift_JIS", "日本"), _declared("EUC-JP", "日本"), _declared("GB2312", "日本"), _declared("Big5", "日本"), _declared("EUC-KR", "한국"), _declared("windows-1252", "€"), _declared("ISO-8859-1", "é"), _declared("UTF-16", "日本"),
    (b"\xef\xbb\xbf" + _RSS.replace("%s", "é").encode(), 200, "true, NULL, 'é', 'rss2.0', 0, 'unknown'"),
    (b'<?xml version="1.0" encoding="Shift_JIS"?><rss><channel><title>\xff\xff</title></channel></rss>', 200, "false, 'UnicodeDecodeError', NULL, NULL, 0, 'unknown'"),
    (b'<?xml version="1.0" encoding="none-such"?><rss/>', 200, "false, 'LookupError', NULL, NULL, 0, 'unknown'"),
    (b"<rss><channel><title>x</channel></rss>", 200, "false, 'mismatched tag', NULL, NULL, 0, 'unknown'"), (b"<rss><channel><item>", 200, "false, 'no element found', NULL, NULL, 0, 'unknown'"), (b"", 200, "false, 'Empty response', NULL, NULL, 0, 'unknown'"),
    (b"no xml", 200, "false, 'Not XML', NULL, NULL, 0, 'unknown'"), (b"<html/>", 200, "false, 'Unknown root tag: html', NULL, NULL, 0, 'unknown'"), (b'<!DOCTYPE r [<!ENTITY e "x">]><rss>&e;</rss>', 200, "false, 'Entity declaration', NULL, NULL, 0, 'unknown'"),
    (_RSS.encode(), 404, "false, NULL, NULL, NULL, 0, 'unknown'"), (_RSS.encode(), 503, "false, NULL, NULL, NULL, 0, 'unknown'"), (_RSS.replace("%s", "moved").encode(), 301, "true, NULL, 'moved', 'rss2.0', 0, 'unknown'"),
    (_ATOM.replace("%s", '<entry><title>same</title><content type="xhtml"><div>a <b>c</b></div></content></entry><entry><title>Same </title><summary>s</summary></entry>').encode(), 200, "true, NULL, 't', 'atom10', 2, 'mixed'"),
    (_ATOM.replace("%s", '<entry><content type="html">&lt;p&gt;</content></entry>').encode(), 200, "true, NULL, 't', 'atom10', 1, 'html'"),
)


@query("SELECT page_id, " + ", ".join(f"(CASE page_id % {len(_VARIED)} " + " ".join(f"WHEN {k} THEN {v[2].rsplit(', ', 5)[c]}" for k, v in enumerate(_VARIED)) + f" END){cast} AS {name}" for c, (name, cast) in enumerate((("valid", "::BOOLEAN"), ("error_type", "::VARCHAR"), ("title", "::VARCHAR"), ("format", "::VARCHAR"), ("entries", "::INT"), ("profile", "::VARCHAR"))))
       + f", (CASE page_id % {len(_VARIED)} WHEN {len(_VARIED) - 2} THEN 2 ELSE 0 END)::INT AS repeated FROM pages")
def parse_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings, faults of many kinds, empty bodies, answers that aren't parsed, nested and repeated content."""
    k = (F.col("page_id") % len(_VARIED)).cast("int")
    rows = _read(spark, sf_dir, "pages").select(F.concat(F.lit("http://h.example.org/f/"), F.col("page_id").cast("string")).alias("url"), F.get(F.array(*(F.lit(v[1]) for v in _VARIED)), k).alias("http_status"),
                                                F.create_map(F.lit("content-type"), F.lit("text/xml")).alias("http_headers"), F.lit("2024-02-01T00:00:00Z").alias("warc_date"), F.lit("feed_media_type").alias("candidate_source"), F.lit(None).cast("string").alias("error"),
                                                F.lit("").alias("warc_path"), F.col("page_id").cast("long").alias("offset"), F.get(F.array(*(F.lit(bytearray(v[0])) for v in _VARIED)), k).alias("body"))
    found = feeds.records(rows, _now())
    return found.select(F.col("offset").alias("page_id"), "valid", "error_type", "title", "format", F.coalesce("entries_count", F.lit(0)).alias("entries"), F.coalesce("content_type_profile", F.lit("unknown")).alias("profile"), F.coalesce("repeated_entry_title_count", F.lit(0)).alias("repeated"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    link = F.when(k == 0, '<link rel="alternate" type="application/rss+xml" title="T" href="/feed">').when(k == 1, "<LINK HREF='a.xml' REL='Feed  Alternate' TYPE='application/atom+xml; x=1'>")
    link = link.when(k == 2, '<link rel="stylesheet" type="text/css" href="/s.css">').when(k == 3, '<!-- <link rel="alternate" type="application/rss+xml" href="/no"> -->').otherwise("")
    meta = F.when(F.col("page_id") % 3 == 0, '<meta content="WordPress 6" name="generator">').otherwise("")
    return _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h"), (F.col("page_id") % 9).cast("string"), F.lit(".example.com/d/"), F.col("page_id").cast("string")).alias("url"),
                                                F.concat(F.lit("<html><head>"), meta, link, F.lit("</head>"), "html").cast("binary").alias("html"))


@query("""SELECT 'http://h' || page_id % 9 || '.example.com/d/' || page_id AS page_url, 'example.com' AS site, 'http://h' || page_id % 9 || '.example.com' || CASE page_id % 5 WHEN 0 THEN '/feed' ELSE '/d/a.xml' END AS feed_url,
  CASE page_id % 5 WHEN 0 THEN 'alternate' ELSE 'alternate feed' END AS rels, CASE page_id % 5 WHEN 0 THEN 'T' ELSE '' END AS title, CASE WHEN page_id % 3 = 0 THEN 'wordpress' ELSE '' END AS fingerprints FROM pages WHERE page_id % 5 < 2""")
def discovery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(_html(spark, sf_dir)).select("page_url", "site", "feed_url", F.array_join("rels", " ").alias("rels"), "title", F.array_join("fingerprints", " ").alias("fingerprints"))


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'wordpress' ELSE 'none' END AS label, count(*) AS pages, count(*) FILTER (page_id % 5 < 2) AS auto_pages FROM pages GROUP BY 1")
def html_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _html(spark, sf_dir)
    rows = pages.described(own, pages.links(own)).withColumn("fingerprints", F.when(F.size("fingerprints") > 0, F.col("fingerprints")).otherwise(F.array(F.lit("none"))))
    return discovery.page_platforms(rows)


@query("SELECT DISTINCT 'http://h.example.org/f/' || event_id % 997 AS feed_url FROM events")
def opml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.format_string('<outline text="t" XMLURL=" http://H.example.org/f/%s/ "/>', (F.col("event_id") % 997).cast("string"))
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), one.alias("o"))
    files = events.groupBy(F.col("g").cast("string").alias("path")).agg(F.concat(F.lit("<opml><body>"), F.array_join(F.collect_list("o"), ""), F.lit("</body></opml>")).cast("binary").alias("content"))
    return lists.opml(files).select("feed_url")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'plain' WHEN 2 THEN 'mixed' ELSE 'unknown' END AS profile FROM pages")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    plain, rich = content.text_content_type(F.lit("a > b")), content.text_content_type(F.lit("<b>"))
    kinds = F.when(k == 0, F.array(rich, rich)).when(k == 1, F.array(plain, content.atom_content_type(F.lit(None).cast("string")))).when(k == 2, F.array(plain, rich))
    return _read(spark, sf_dir, "pages").select("page_id", content.content_profile(kinds).alias("profile"))


