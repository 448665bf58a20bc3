"""What a larger table must not cost: expressions that are evaluated once, and batches that are bounded by bytes."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import functions as F

from syndilake.functions import platforms, url
from syndilake.operators import feed_parser
from syndilake.operators.batches import pieces
from syndilake.plans import feeds as reports
from syndilake.sources import lists


def registrable(name, suffixes):
    """The rule of functions.url.site(), label by label."""
    labels = name.split(".")
    tails = [".".join(labels[k:]) for k in range(len(labels) + 1)]
    spared = [len(labels) - k - 1 for k in range(len(labels)) if "!" + tails[k] in suffixes]
    found = [len(labels) - k for k in range(len(labels)) if tails[k] in suffixes or tails[k + 1] and "*." + tails[k + 1] in suffixes]
    longest = max(spared) if spared else max([1, *found])
    return name if len(labels) <= longest else ".".join(labels[-longest - 1 :])


def test_sites_label_by_label(spark):
    names = {".".join(p) for n in (1, 2, 3, 4) for p in product(("a", "b", "ck", "www", "x-y", ""), repeat=n)}
    names = sorted(n for n in names if n and n == n.strip("."))
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for suffixes in (("b", "ck", "a.b", "www.a.b"), ("*.ck", "!www.ck", "b"), ("*.a.b", "!ck.a.b", "!b.ck.a.b", "x-y", "*.x-y", "a.b"), ("!ck",), ()):
        got = {r.name: r.site for r in rows.select("name", url.site(F.col("name"), suffixes).alias("site")).collect()}
        assert {n: s for n, s in got.items() if s != registrable(n, suffixes)} == {}


def test_sites_are_found_once_for_each_feed(spark):
    """Not once for each of the rows that feeds are made of, and in an expression that doesn't grow with its own parts."""
    made = spark.range(20).groupBy((F.col("id") % 5).alias("u")).count().select(F.concat(F.lit("http://b"), F.col("u").cast("string"), F.lit(".example.org/")).alias("url"))
    found = reports.sites(made)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan[plan.rindex("Aggregate [") :]
    assert plan.count("regexp_extract") < 40
    assert found.first().sites == 1
    assert reports.sites(spark.createDataFrame([("http:///x",), ("http://a.org",), (None,)], "url string")).first().sites == 1


def test_pieces():
    bodies = pa.array([b"x" * 600, None, b"", b"x" * 600, b"x" * 5000, b"x"])
    assert list(pieces(bodies, 1024)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert list(pieces(bodies, 4096)) == [(0, 4), (4, 5), (5, 6)]
    assert list(pieces(bodies.slice(4), 8192)) == [(0, 2)] and list(pieces(bodies.slice(6))) == []


def test_opml_is_handed_back_in_pieces(spark, monkeypatch):
    """A batch of many documents isn't held as entries; the plan has no array of all entries of a batch."""
    document = b"<opml><body>" + b"".join(b'<outline text="t" xmlUrl="http://e.org/%d"/>' % k for k in range(100)) + b"</body></opml>"
    seen = []
    monkeypatch.setattr(lists, "outlines", lambda body, real=lists.outlines: seen.append(1) or real(body))
    arrow = pa.schema([("path", pa.string()), ("feed_url", pa.string()), ("html_url", pa.string()), ("title", pa.string()), ("pos", pa.int32())])
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(2000)], "_body": pa.array([document] * 1999 + [None], pa.binary())})
    rows = 0
    for found in lists.entries(iter([batch]), arrow):
        assert len(seen) <= 1024 and found.nbytes < 8 << 20  # documents read since the last piece
        seen.clear()
        rows += found.num_rows
    assert rows == 1999 * 100
    own = lists.opml(spark.createDataFrame([("a", document), ("b", document)], "path string, content binary"))
    assert "MapInArrow" in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.count() == 100


def test_feeds_are_handed_back_in_pieces(spark, monkeypatch):
    """A batch of many documents isn't held as structs."""
    document = b"<rss><channel>" + b"".join(b"<item><title>%d</title></item>" % k for k in range(100)) + b"</channel></rss>"
    seen, real = [], feed_parser.parse
    monkeypatch.setattr(feed_parser, "parse", lambda body: seen.append(1) or real(body))
    bodies, taken = [document] * 1999 + [None], {}
    own = spark.createDataFrame([("a", document), ("b", None)], "url string, body binary")
    monkeypatch.setattr(type(own), "mapInArrow", lambda self, run, target: taken.update(run=run))
    feed_parser.parsed(own)
    rows = []
    for found in taken["run"](iter([pa.RecordBatch.from_pydict({"url": [str(k) for k in range(2000)], "_body": pa.array(bodies, pa.binary())})])):
        assert len(seen) <= 1024  # documents parsed since the last piece
        seen.clear()
        rows += found.select(["url"]).to_pydict()["url"]
        assert found.column("parsed")[0].as_py()["entries_count"] == 100
    assert rows == [str(k) for k in range(2000)]


def test_a_page_is_decoded_once(spark):
    """Its head isn't computed anew for each marker, nor what a generator names for each platform."""
    page = b"<html><meta content='Drupal 9' name='generator'><meta name=\"generator\" content=\"x wp.com\"><script src='https://CDN.shopify.com/a'>"
    rows = spark.createDataFrame([(page,), (b"<meta name='generator'",), (b"",), (None,)], "html binary")
    found = rows.select(platforms.of_html(F.col("html")).alias("f"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("html#") <= 3
    assert [r.f for r in found.collect()] == [["drupal", "shopify", "wordpress"], [], [], []]
