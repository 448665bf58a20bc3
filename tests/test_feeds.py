"""Parsing, records, routing, discovery, sources and reports of feeds, on literals."""

from __future__ import annotations

import gzip
import io
import math
import zipfile
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from syndilake import mock, schema
from syndilake.functions import content, dates, platforms, text, url
from syndilake.operators import feed_parser, feeds, pages, routing
from syndilake.plans import discovery, distributions, quality, sketches, timing
from syndilake.plans import feeds as reports
from syndilake.report import render, survey
from syndilake.report.probe import probe
from syndilake.sources import fetch, lists, warc



def now():
    return F.to_timestamp(F.lit("2026-05-01T00:00:00Z"))


def values(spark, function, items, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}")
    return [r.v for r in frame.select("k", function(F.col("x")).alias("v")).orderBy("k").collect()]


# -- functions

URLS = [
    ("HTTP://User:PW@Example.ORG:80/A/b/?q=1#f", "http://user:pw@example.org/A/b?q=1"),
    ("https://example.org:443", "https://example.org/"),
    ("https://example.org:8443/x;p=1?y", "https://example.org:8443/x?y"),
    ("http://[2001:DB8::1]:80/", "http://[2001:db8::1]/"),
    ("http://example.org:bad/", "http://example.org:bad/"),
    ("  http://example.org/a b/  ", "http://example.org/a b"),
    ("", ""),
    (None, ""),
]


def test_normalised_urls(spark):
    assert values(spark, url.normalize_url, [a for a, _ in URLS]) == [b for _, b in URLS]
    assert values(spark, url.normalize_url_for_grouping, ["http://a.org/x/?q=1"]) == ["http://a.org/x"]


def test_hosts_and_sites(spark):
    names = ["https://www.Example.co.uk/x", "https://foo.github.io/", "http://192.0.2.7:8080/", "http://[2001:db8::1]/x", "localhost/path", "Sub.Example.com.", "http://a.b.unknowntld/", "httpbin.org", "x.y.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "", "co.uk"]
    assert values(spark, url.site, names) == ["example.co.uk", "foo.github.io", "192.0.2.7", "2001:db8::1", "localhost", "example.com", "b.unknowntld", "httpbin.org", "x.y.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp", "", "co.uk"]
    assert values(spark, url.host, names[:4]) == ["www.example.co.uk", "foo.github.io", "192.0.2.7", "2001:db8::1"]


def test_media_types(spark):
    heads = ['Text/XML; x=1; charset="UTF-8"; charset=Latin1', "application/foo+rss", None, "application/feed+json"]
    assert values(spark, content.media_type, heads) == ["text/xml", "application/foo+rss", "", "application/feed+json"]
    assert values(spark, content.charset, heads) == ["latin1", "", "", ""]
    assert values(spark, lambda c: content.is_feed_type(content.media_type(c)), heads) == [False, True, False, False]
    assert values(spark, content.is_interesting_payload, [None, "", "image/png", "text/html"]) == [True, True, False, True]
    assert values(spark, content.known_media_type, [None, "a/b"]) == ["unknown", "a/b"]


def test_sniffing(spark):
    bodies = [b"\xff\xfe <RSS version", b'<feed xmlns="http://www.w3.org/2005/Atom">', b"<feed xmlns='http://www.w3.org/2005/Atom'>", b'<rdf:RDF xmlns="http://purl.org/rss/1.0/">', b"x" * 1000 + b"<rss", b"", None]
    assert values(spark, content.sniff, bodies, "binary") == ["rss", "atom", "unknown", "rdf", "unknown", "unknown", "unknown"]


def test_platforms(spark):
    assert values(spark, platforms.of_value, ["WordPress 6.1", "mediumish", "http://wp.com/x", None, "Blogspot/Drupal"]) == [["wordpress"], [], ["wordpress"], [], ["blogger", "drupal"]]
    html = [b'<META content="Ghost 5" name="generator">', b"<meta name='generator' content='x'><link href='/wp-content/a.css'>", b"<p>ghost</p>", None]
    assert values(spark, platforms.of_html, html, "binary") == [["ghost"], ["wordpress"], [], []]
    frame = spark.createDataFrame([({"x-powered-by": "Drupal", "server": "nginx"},), (None,)], "h map<string,string>")
    assert [r.v for r in frame.select(platforms.of_headers(F.col("h")).alias("v")).collect()] == [["drupal"], []]


def test_labels_of_texts(spark):
    assert values(spark, text.entry_title, ["  A \n b ", None]) == ["a b", ""]
    assert values(spark, text.error_label, ["mismatched tag: line 1, column 22", "a, b", "\nfirst\nsecond", "", None, "x" * 200]) == ["mismatched tag", "a", "first", "ParseError", "ParseError", "x" * 157 + "..."]
    pairs = spark.createDataFrame([("http://purl.org/dc/elements/1.1/", "creator"), ("http://e.org/ns", "x"), ("http://e.org/ns/", "x")], "a string, b string")
    got = pairs.select(text.extension_label(F.col("a"), F.col("b")).alias("v")).select("v", text.specification(F.col("v")).alias("s")).collect()
    assert [r.v for r in got] == ["dc:creator", "http://e.org/ns#x", "http://e.org/ns/x"]
    assert got[0].s.startswith("https://www.dublincore.org") and got[1].s is None
    own = text.repeats(F.array(*map(F.lit, ["a", "b", "a", "untitled", ""])))
    assert tuple(spark.range(1).select(*(own[k].alias(k) for k in ("n", "repeated", "ratio", "stock"))).first()) == (4, 2, 0.5, 1)


def test_ages_and_cadence(spark):
    frame = spark.createDataFrame([("2026-04-21T00:00:00Z",), ("2026-05-01T12:00:00Z",), ("2026-05-03T00:00:00Z",), (None,)], "x string")
    at = F.to_timestamp("x")
    assert [r.v for r in frame.select(dates.age_days(at, now()).alias("v")).collect()] == [10.0, 0.0, None, None]
    assert [r.v for r in frame.select(dates.recently(at, now()).alias("v")).collect()] == [False, False, False, False]
    assert values(spark, dates.cadence_bucket, [None, 0.5, 1.0, 2.0, 8.0, 32.0], "double") == ["unknown", "sub-daily", "daily", "weekly", "monthly", "slower"]
    assert values(spark, lambda c: F.unix_seconds(dates.request_time(c, now())), ["2026-04-26T12:00:00Z", "junk"]) == [1777204800, 1777593600]


# -- feeds

RSS = b"""<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xml:lang="EN">
<channel xml:lang="de"><image><title>Image first</title></image><title>News</title><link>https://Example.org:443/?a=1</link><language>fr</language><pubDate>Mon, 02 Jan 2006 15:04:05 GMT</pubDate>
<lastBuildDate>Tue, 21 Apr 2026 00:00:00 +0200</lastBuildDate><generator>WordPress 6</generator><atom:link rel="self" href="x"/><atom:link rel="hub next" href="y"/>
<item><title>One</title><link>http://e.org/a?x=1</link><pubDate>bad</pubDate><dc:date>2026-04-18T10:00:00+02:00</dc:date><description>&lt;b&gt;hi&lt;/b&gt;</description><dc:language>ES</dc:language></item>
<item><title> one </title><link>http://e.org/a?x=2</link><pubDate>Sun, 19 Apr 2026 08:00:00 GMT</pubDate><content:encoded>body text</content:encoded></item>
<item><title>Untitled</title><pubDate>Mon, 20 Apr 2026 08:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = b"""<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en"><title>A</title><link rel="self" href="http://e.org/self"/><link href="http://e.org/home" hreflang="DE"/>
<updated>2026-04-20T00:00:00Z</updated><published>2020-01-01T00:00:00Z</published><entry xml:lang="it"><title>t</title><published>2026-01-01T00:00:00Z</published><updated>2026-02-01T00:00:00+02:00</updated>
<link href="http://e.org/1?x" hreflang="fr"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>four</p>more</div></content><summary>s</summary></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel xml:lang="ja"><title>R</title><link>http://r.org</link>
<dc:date>2026-04-01</dc:date><dc:date>2020-01-01</dc:date></channel><item><title>i</title><dc:date>2026-03-01T00:00:00Z</dc:date></item></rdf:RDF>"""


def seconds(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp())


def test_rss2():
    got = feed_parser.parse(RSS)
    assert (got["format"], got["entries_count"], got["title"], got["link"]) == ("rss2.0", 3, "Image first", "https://Example.org:443/?a=1")
    assert got["lang_feed"] == "en" and got["lang_entries"] == ["es"] and got["all_languages"] == ["de", "en", "es"]
    assert got["updated"] == seconds(2026, 4, 20, 22) and got["newest"] == seconds(2026, 4, 20, 8) and got["oldest"] == seconds(2026, 4, 18, 8)
    assert got["content_types"] == ["html"] and got["content_lengths"] == [9, 9] and got["has_summary"] and got["has_content"]
    assert dict(got["feed_links"]) == {"self": 1, "hub": 1, "next": 1}
    assert {(x["ns"], x["local"]) for x in got["extensions"]} >= {("http://purl.org/rss/1.0/modules/content/", "encoded")}


def test_atom():
    got = feed_parser.parse(ATOM)
    assert (got["format"], got["link"], got["lang_feed"], got["hreflang_values"]) == ("atom10", "http://e.org/home", "en", ["de", "fr"])
    assert got["updated"] == seconds(2026, 4, 20) and got["newest"] == seconds(2026, 1, 31, 22)
    assert got["content_types"] == ["plain", "xhtml"] and got["content_lengths"] == [8, 1] and got["lang_entries"] == ["it"]


def test_rss1():
    got = feed_parser.parse(RDF)
    assert (got["format"], got["title"], got["lang_feed"], got["updated"], got["newest"]) == ("rss10", "R", "ja", seconds(2026, 4, 1), seconds(2026, 3, 1))


@pytest.mark.parametrize(
    ("body", "kind"),
    [(b"", "Empty response"), (b"plain", "Not XML"), (b"<rss><a></rss>", "mismatched tag"), (b"<html/>", "Unknown root tag: html"), (b"  <?xml version='1.0'?><rss/>", "XML or text declaration not at start of entity"),
     (b"<!DOCTYPE rss [<!ENTITY a 'b'>]><rss>&a;</rss>", "Entity declaration")],
)
def test_what_is_no_feed(body, kind):
    assert feed_parser.parse(body)["error_type"] == kind


def test_atom_without_a_namespace_is_valid_and_empty():
    got = feed_parser.parse(b"<feed><entry/></feed>")
    assert got["error"] is None and got["entries_count"] == 0


def responses(spark, *rows):
    """url, type, body, status."""
    blank = dict.fromkeys(schema.RESPONSES.fieldNames())
    made = [blank | {"record_type": "response", "url": u, "warc_date": "2026-04-26T12:00:00Z", "http_status": s, "http_headers": {"content-type": t, "content-language": "EN, de", "server": "ghost"}, "body": b, "offset": k} for k, (u, t, b, s) in enumerate(rows)]
    return spark.createDataFrame(made, schema.RESPONSES)


def test_records(spark):
    rows = responses(spark, ("HTTP://e.org/feed/", "application/rss+xml; charset=utf-8", RSS, 200), ("http://e.org/404", "text/html", b"x", 404), ("http://e.org/bad", "text/xml", b"<rss>", 200))
    got = {r.url: r for r in feeds.records(rows, now()).collect()}
    one = got["http://e.org/feed"]
    assert one.valid and one.link == "https://example.org/?a=1" and one.lang_http == "en" and one.charset == "utf-8"
    assert one.languages == ["en", "es"] and one.fingerprints == ["ghost", "wordpress"]
    assert (one.entry_title_count, one.repeated_entry_title_count, one.default_entry_title_count, one.repeated_entry_link_count) == (3, 2, 1, 2)
    assert (one.has_self_link, one.has_hub_link, one.has_paging_link, one.has_archive_link) == (True, True, True, False)
    assert one.update_cadence_days == 1.0 and one.update_cadence_bucket == "daily" and one.updated_recently and one.entry_recently
    assert not got["http://e.org/404"].valid and got["http://e.org/404"].error is None
    assert got["http://e.org/bad"].error_type == "no element found"
    assert [f.name for f in schema.FEEDS.fields] == feeds.records(rows, now()).drop("warc_path", "offset").columns


def test_routes(spark):
    rows = responses(
        spark,
        ("http://a.org/p", "text/html", b"<html>", 500), ("http://a.org/f", "application/atom+xml", ATOM, 200), ("http://a.org/f", "application/atom+xml", ATOM, 301), ("http://a.org/x", "application/xml", RSS, 200),
        ("http://a.org/o", "application/xml", b"<OAI/>", 200), ("http://a.org/i", "image/png", b"", 200), ("http://a.org/t", "text/html", RSS, 200), ("", "text/html", b"", 200), ("http://a.org/t2", "text/atom", ATOM, 200),
    )
    got = [r.route for r in routing.routed(rows).orderBy("offset").collect()]
    assert got == ["html", "feed", "none", "sniffed", "none", "dropped", "html", "html", "dropped"]
    assert routing.scoped(rows, None).count() == 8
    assert routing.scoped(rows, spark.createDataFrame([("b.org",), ("",)], "site string")).count() == 0
    counted = routing.counters(routing.routed(routing.scoped(rows, None))).first()
    assert (counted.responses_processed, counted.pages_processed, counted.html_pages, counted.feeds_sniffed, counted.sites) == (8, 6, 2, 1, 1)


HTML = b"""<html><head><meta name=generator content=x><meta content="WordPress" name="generator"><link rel="alternate" type="application/rss+xml" href="/feed/#x" title="T" hreflang="de">
<LINK REL='Alternate Feed' TYPE='application/atom+xml; charset=utf-8' href='atom.xml'><link rel = "feed" type="application/rdf+xml" href="http://O.org/r"><link rel="alternate" type="application/rss+xml" href="/feed/">
<link rel="alternate" type="application/feed+json" href="/j"><!-- <link rel="alternate" type="application/rss+xml" href="/no"> --></head></html>"""


def test_links(spark):
    rows = spark.createDataFrame([("http://w.example.org/d/p", HTML), ("http://e.org/", b"<link rel=alternate type=application/rss+xml href=/x>"), ("http://n.org/", None)], "url string, html binary")
    found = pages.links(rows)
    got = [(r.feed_url, r.rels, r.site, r.fingerprints) for r in found.collect()]
    assert got == [("http://w.example.org/feed", ["alternate"], "example.org", ["wordpress"]), ("http://w.example.org/d/atom.xml", ["alternate", "feed"], "example.org", ["wordpress"]),
                   ("http://o.org/r", ["feed"], "example.org", ["wordpress"]), ("http://w.example.org/feed", ["alternate"], "example.org", ["wordpress"])]
    assert pages.links(rows, prefilter=False).count() == 5
    totals = discovery.page_totals(found).first()
    assert tuple(totals) == (1, 1, 1, 1, 1, 1)
    counts = {r.feed_url: (r.links, r.sites) for r in discovery.feed_counts(found).collect()}
    assert counts["http://w.example.org/feed"] == (2, 1)
    assert {r.label: r.n for r in discovery.links_per_page(found).filter("n > 0").collect()} == {"3": 1}
    described = {r.url: (r.fingerprints, r.has_links) for r in pages.described(rows, found).collect()}
    assert described["http://w.example.org/d/p"] == (["wordpress"], True) and described["http://n.org/"] == ([], False)


# -- quality

BASE = {"valid": True, "entries_count": 20, "has_content": True, "has_summary": True, "content_lengths": [2000, 2000], "content_type_profile": "html", "title": "t", "link": "l", "lang_feed": "en", "lang_entries": ["en"],
        "newest_entry_date": datetime(2026, 5, 1), "oldest_entry_date": datetime(2026, 1, 1), "updated_date": datetime(2026, 5, 1), "entry_title_count": 10}
CASES = [
    ({}, 1.0), ({"newest_entry_date": datetime(2026, 1, 1)}, 0.825), ({"newest_entry_date": None, "updated_date": None}, 0.0), ({"newest_entry_date": datetime(2024, 1, 1), "updated_date": datetime(2024, 1, 1)}, 0.0),
    ({"newest_entry_date": datetime(2024, 1, 1)}, 0.0), ({"newest_entry_date": datetime(2099, 1, 1)}, 1.0), ({"error": "x"}, 0.0), ({"error": ""}, 1.0), ({"valid": False}, 0.0), ({"repeated_entry_title_ratio": 0.8}, 0.55),
    ({"default_entry_title_count": 1}, 0.7), ({"repeated_entry_link_ratio": 0.8}, 0.65), ({"repeated_entry_title_ratio": 0.9, "repeated_entry_link_ratio": 0.9}, 0.45), ({"default_entry_title_count": 5}, 0.55),
]


def test_scores(spark):
    blank = dict.fromkeys(schema.FEEDS.fieldNames())
    rows = spark.createDataFrame([blank | BASE | {"url": str(k)} | change for k, (change, _) in enumerate(CASES)], schema.FEEDS)
    got = {int(r.url): r.score for r in quality.scored(rows, now()).collect()}
    # age of 120 days halves recency
    assert [got[k] for k in range(len(CASES))] == [pytest.approx(want, abs=1e-3) for _, want in CASES]


def test_report_of_made_up_feeds(spark, tmp_path):
    made = mock.feeds(spark, 2_000, now()).persist()
    assert made.schema == schema.FEEDS or [f.name for f in made.schema] == schema.FEEDS.fieldNames()
    assert reports.valid(made).count() + reports.errors(made).agg(F.sum("n")).first()[0] == 2_000
    links = spark.createDataFrame([("http://p/1", "p", "https://site1.example.com/feed", ["alternate"], []), ("http://p/1", "p", "https://site2.example.com/feed", ["feed"], ["ghost"])], "page_url string, site string, feed_url string, rels array<string>, fingerprints array<string>")
    described = spark.createDataFrame([("http://p/1", ["ghost"], True), ("http://p/2", [], False)], "url string, fingerprints array<string>, has_links boolean")
    counters = spark.createDataFrame([("2026-05-01T00:00:00Z", 2, 3)], "max_crawl_time string, html_pages long, sites long")
    kept = {"feeds": made, "links": links, "pages": described, "page_types": spark.createDataFrame([("text/html",)], "content_type string"), "counters": counters}
    out = survey.report(kept, "Mock | survey", str(tmp_path / "r.html"))
    made.unpersist()
    marked = out[str(tmp_path / "r.md")]
    assert "## Quality" in marked and "| wordpress" in marked and "<h2>Discovery</h2>" in out[str(tmp_path / "r.html")]


def test_rendering():
    assert render.table(["a", "b"], [["x|y", 12345], [None, "l\nm"]]) == "| a    | b      |\n| ---- | ------ |\n| x\\|y | 12,345 |\n|      | l m    |"
    assert render.halves([[1], [2], [3]]) == [[1, 3], [2, ""]]
    assert render.beside("a/b.html") == "a/b.md" and render.opml_title("/x/y.opml") == "OPML: y.opml"


def test_errors_are_folded(spark):
    blank = dict.fromkeys(schema.FEEDS.fieldNames())
    rows = [blank | {"url": str(k), "valid": False, "error": f"Unknown root tag: r{k:02}"} for k in range(17)] + [blank | {"url": "a", "valid": False, "status": 500}, blank | {"url": "b", "valid": False, "status": 0}]
    got = [tuple(r) for r in reports.errors(spark.createDataFrame(rows, schema.FEEDS)).collect()]
    assert got[-1] == ("Other unknown root tags", 2, True) and ("HTTP 500", 1, False) in got and ("Error", 1, False) in got and len(got) == 18


def test_latest_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 3, "y")], "url string, request_time long, v string")
    assert {(r.url, r.v) for r in reports.latest(rows).collect()} == {("a", "y"), ("b", "z")}


def test_natural_and_simple_histograms(spark):
    rows = spark.createDataFrame([(0,), (127,), (128,), (1024,), (5000,)], "v long")
    assert [(r.label, r.n) for r in distributions.natural_histogram(rows, "v").collect()] == [("0", 1), ("-127", 1), ("-254", 1), ("-511", 0), ("-1023", 0), ("-2k", 1), ("-4k", 0), ("-8k", 1)]
    assert [(r.low, r.label, r.n) for r in distributions.simple_histogram(rows.filter("v < 200"), "v").collect()] == [(0, "-11", 1), (120, "-131", 2)]
    assert [(r.label, r.n) for r in distributions.simple_histogram(rows.filter("v = 0"), "v").collect()] == [("0", 1)]


def test_sketches_merge(spark):
    names = [f"s{k}" for k in range(3_000)]
    found: dict[int, int] = {}
    for name in names:
        h = zlib.crc32(name.encode())
        rest = h >> 12
        found[h & 4095] = max(found.get(h & 4095, 0), 20 - rest.bit_length() + 1)
    rows = spark.createDataFrame([(x,) for x in names], "site string")
    parts = sketches.merged(sketches.registers(rows.filter("site < 's2'")), sketches.registers(rows.filter("site >= 's1'")))
    assert {r.register: r.rho for r in parts.collect()} == found
    assert sketches.estimate(parts).first().sites == int(4096 * math.log(4096 / (4096 - len(found))))
    assert sketches.estimate(sketches.registers(rows.limit(0))).first().sites == 0


# -- sources

def block(kind, target, payload):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {target}\r\nWARC-Date: 2026-04-26T12:00:00Z\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return gzip.compress(head + payload + b"\r\n\r\n")


def http(kind, body):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nX-Folded: a\r\n b\r\n\r\n".encode() + body


def test_warc_to_facts(spark, tmp_path):
    records = [block("warcinfo", "", b"x: y"), block("response", "http://w.example.org/d/p", http("text/html", HTML)), block("request", "http://w.example.org/", b"GET"), block("response", "http://o.org/r", http("application/rss+xml", RSS)), block("response", "http://bad.org/", b"junk")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(records)[:-40])
    (tmp_path / "c.warc").write_bytes(gzip.decompress(records[1]))
    rows = warc.read_warc(spark, str(tmp_path / "*.warc*")).persist()
    assert rows.filter("error is null").count() == 3 + 2 + 1
    assert [r.error for r in rows.filter("error is not null").collect()] == ["EOFError"]
    assert {r.f for r in rows.filter("url = 'http://o.org/r'").select(F.col("http_headers")["x-folded"].alias("f")).collect()} == {"a b"}
    assert warc.read_warc(spark, str(tmp_path / "a.warc.gz"), limit_records=2).count() == 1
    assert warc.read_warc_store(spark, str(tmp_path / "a.warc.gz")).count() == 3
    assert warc.read_warc(spark, str(tmp_path / "none")).first().error == "FileNotFoundError"
    folder = str(tmp_path / "facts")
    kept = survey.facts(survey.staged(rows, None, folder), now(), folder)
    assert [r.url for r in kept["feeds"].collect()] == ["http://o.org/r"]
    assert kept["links"].filter("feed_url = 'http://o.org/r'").count() == 3  # the page is in each file
    assert kept["counters"].first().max_crawl_time == "2026-04-26T12:00:00Z"
    rows.unpersist()


def test_lists(spark, tmp_path):
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"a\n\n# no\n b \nc\n"))
    assert [r.path for r in lists.paths(spark, str(tmp_path / "p.gz"), 2).collect()] == ["a", "b"]
    (tmp_path / "top.csv").write_text("1,www.Example.com\n2,example.com\n3,x,y\nbad\n4,foo.github.io\n5,late.org\n")
    assert {r.site for r in lists.top_sites(spark, str(tmp_path / "top.csv"), 5).collect()} == {"example.com", "foo.github.io"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("readme", "x")
        z.writestr("top.CSV", "1,a.org")
    assert lists.first_csv(packed.getvalue()) == b"1,a.org"
    assert lists.latest_crawl('[{"id": "C-2"}, {"id": "C-1"}]') == "C-2"
    with pytest.raises(ValueError, match="no crawl"):
        lists.latest_crawl("[]")
    assert [lists.subdomains_listed(x) for x in (None, "0", "Standard", "yes")] == [True, False, False, True]
    (tmp_path / "s.opml").write_bytes(b'<opml><body><outline text="F"><outline XMLUrl=" http://E.org/f/ " HTMLURL="http://e.org" Title="t"/><outline xmlUrl="http://e.org/f" text="again"/><outline text="no"/></outline><broken')
    assert [tuple(r) for r in lists.read_opml(spark, str(tmp_path / "s.opml")).collect()] == [("http://e.org/f", "http://e.org/", "t", 0)]
    (tmp_path / "part-0").write_text('"feed"\t{"a": 1}\nbroken\n"x"\t{bad\n')
    assert [(r.label, r.data) for r in lists.result_lines(spark, str(tmp_path)).collect()] == [("feed", '{"a": 1}')]


def test_logs_and_timing(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "stderr.gz").write_bytes(gzip.compress(b"init_ms=10 jitter_ms=5\nfinished w1 total_ms=100 process_ms=60 iterator_ms=30 records=7\nfinished w2 total_ms=300 process_ms=60 iterator_ms=30 records=7\nfailed w3 signal 11\n"))
    (tmp_path / "stderr").write_text("init_ms=99\n")
    done, failed, begun = lists.logs(spark, str(tmp_path))
    assert done.count() == 2 and failed.first().error == "warc_signal_11" and [r.init_ms for r in begun.collect()] == [10]
    assert tuple(timing.metric(done, "total_ms").first()) == ("total_ms", 2, 400, 200.0, 200.0, 100, 300)
    assert timing.slowest(done, 1).first().warc_path == "w2" and timing.shares(done).first().process_pct == 30.0
    assert timing.failures(failed).first().n == 1


def fake(address):
    answers = {"http://w.example.org/d/p": (200, {"content-type": "text/html"}, HTML), "http://o.org/r": (200, {"content-type": "application/rss+xml"}, RSS)}
    if address not in answers:
        raise fetch.ResponseTooLarge(address)
    return answers[address]


def test_opml_survey_and_probe(spark, tmp_path):
    entries = spark.createDataFrame([("http://o.org/r", "http://w.example.org/d/p", "t", 0), ("http://gone.org/", None, "", 1)], schema.OPML_ENTRY)
    rows = survey.opml_responses(spark, entries, fake).persist()
    got = survey.opml_facts(rows, now(), str(tmp_path / "facts"))
    assert {(r.url, r.valid, r.error) for r in got["feeds"].collect()} == {("http://o.org/r", True, None), ("http://gone.org/", False, "ResponseTooLarge")}
    assert got["links"].count() == 4
    rows.unpersist()
    page = probe(spark, "http://w.example.org/d/p", fake, recursive=True, most=3)
    assert "## Announced feeds" in page and "| http://o.org/r" in page and "Could not be read: ResponseTooLarge" in page and "### Feed" in page
    assert "Could not be read" in probe(spark, "http://gone.org/", fake)


def test_streaming_intake(spark, tmp_path):
    from syndilake.streaming import intake

    rows = responses(spark, ("http://a.org/f", "application/rss+xml", RSS, 200), ("http://A.org/f/", "application/rss+xml", RSS, 200), ("http://a.org/p", "text/html", b"x", 200))
    rows.write.parquet(str(tmp_path / "in"))
    stream = intake.records(spark.readStream.schema(schema.RESPONSES).parquet(str(tmp_path / "in")), now())
    intake.append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["http://a.org/f"]
