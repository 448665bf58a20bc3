"""Streams from stores, WARC files of any place, top-site caches, suffix tables, timings and made-up facts."""

from __future__ import annotations

import gzip
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from syndilake import mock
from syndilake.functions import url
from syndilake.operators import sites
from syndilake.plans import discovery
from syndilake.report import render, survey
from syndilake.sources import lists, stores, warc


def block(kind, target, payload):
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {target}\r\nWARC-Date: 2024-02-01T00:00:00Z\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n")


def http(body):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body


class Answer(io.BytesIO):
    """An answer that breaks off after some bytes."""

    def __init__(self, data, length, status, breaks):
        super().__init__(data[:breaks] if breaks else data)
        self.headers, self.status, self.broken = {"Content-Length": str(length)}, status, breaks

    def read(self, n=-1):
        data = super().read(n)
        if not data and self.broken:
            raise ConnectionResetError
        return data


@pytest.mark.parametrize("ranges", [True, False])
def test_broken_answers_are_continued(ranges):
    data, asked = bytes(range(256)) * 400, []

    def opener(request, timeout):
        start = int((request.get_header("Range") or "bytes=0-")[6:-1])
        asked.append(start)
        own = data[start:] if ranges else data
        return Answer(own, len(data), 206 if start and ranges else 200, 30_000 if len(asked) < 3 else None) if ranges or start < 25_000 else Answer(data, len(data), 200, None)

    assert io.BufferedReader(stores.Ranged("http://x/", opener), 10_000).read() == data
    assert len(asked) > 1

    def dead(request, timeout):
        raise ConnectionRefusedError

    with pytest.raises(OSError):
        stores.Ranged("http://x/", dead).read(1)


def test_warcs_of_any_place(spark, tmp_path):
    """Plain paths, URIs and patterns; long bodies are cut with a mark, broken and missing files have a row that says so."""
    whole = b"".join(block("response", f"http://h/{k}", http(b"x" * (3_000 if k == 1 else 10))) for k in range(3))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(whole[:-30])
    for pattern in (f"{tmp_path}/*.warc.gz", f"file://{tmp_path}/*.warc.gz"):
        rows = warc.read_warc(spark, pattern, body_bytes=1_000).collect()
        assert sorted((os.path.basename(r.warc_path), r.url, r.truncated, len(r.body or b""), r.error) for r in rows if r.error is None) == sorted(
            (f, f"http://h/{k}", k == 1, 1_000 if k == 1 else 10, None) for f, n in (("a.warc.gz", 3), ("b.warc.gz", 2)) for k in range(n))
        assert [(os.path.basename(r.warc_path), r.error) for r in rows if r.error] == [("b.warc.gz", "EOFError")]
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (f"{tmp_path}/none",), (None,)], "path string")
    got = warc.read_warcs(spark, paths, limit_records=2).collect()
    assert sorted((r.url or "", r.error) for r in got) == [("", "FileNotFoundError"), ("http://h/0", None), ("http://h/1", None)]


def test_sites_by_a_table_are_those_of_the_expression(spark, tmp_path):
    rng = random.Random(1)
    tails = [s.lstrip("*.!") for s in url.SUFFIXES] + ["unknown", "a.unknown", "ward.kawasaki.jp", "x.ck", "www.ck"]
    rows = [(".".join([rng.choice(["a", "b", "www", "city"]) for _ in range(rng.randint(0, 3))] + [rng.choice(tails)]),) for _ in range(600)] + [("",), ("10.1.2.3",), (None,), ("http://[::1]:8/",)]
    (tmp_path / "list.dat").write_text("// rules\n\n" + "\n".join(f"{s} // note" for s in url.SUFFIXES), encoding="utf-8")
    frame = spark.createDataFrame(rows, "u string").withColumn("want", url.site(F.col("u")))
    for table in (sites.suffix_table(spark), sites.read_suffixes(spark, str(tmp_path / "list.dat"))):
        found = sites.with_site(frame, F.col("u"), table)
        assert found.count() == len(rows) and found.filter(~F.col("site").eqNullSafe(F.col("want"))).count() == 0
        assert found.columns == ["u", "want", "site"]


def test_top_lists_are_found_fetched_and_kept(spark, tmp_path):
    cache = tmp_path / "cache"
    text = "1,www.a.co.uk\n2,b.com\nbad line\n3,x.b.com\n"
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("top.csv", text)
    raw = lists.fetch_list("http://x/list.zip", str(cache), True, lambda u: io.BytesIO(archive.getvalue()))
    assert open(raw).read() == text and lists.find_list([str(tmp_path), str(cache)], True) == (raw, False)
    assert lists.fetch_list("http://x/list.zip", str(cache), True, lambda u: 1 / 0) == raw
    kept = lists.cached_sites(spark, raw, str(cache), True)
    assert {(r["rank"], r.site) for r in kept.collect()} == {(1, "a.co.uk"), (2, "b.com"), (None, None), (3, "b.com")}
    assert {(r["rank"], r.site) for r in lists.first_sites(kept).collect()} == {(1, "a.co.uk"), (2, "b.com")} == {(r["rank"], r.site) for r in lists.top_sites(spark, raw).collect()}
    assert lists.first_sites(kept, 1).count() == 1
    assert lists.find_list([str(cache)], True) == (str(cache / lists.list_name(True, True)), True) and lists.find_list([str(cache)], False) is None
    open(raw, "a").write("4,c.org\n")
    assert lists.cached_sites(spark, raw, str(cache), True).count() == 5
    with pytest.raises(ZeroDivisionError):
        stores.download("u", str(tmp_path / "x"), lambda u: 1 / 0)
    assert not (tmp_path / "x").exists() and lists.list_label(True) != lists.list_label(False)


def test_timings_as_markdown(spark):
    done = spark.createDataFrame([("l", f"w{k}", 1_000 * k, 600 * k, 400 * k, 10) for k in range(1, 13)], "log string, warc_path string, total_ms long, process_ms long, iterator_ms long, records long")
    failed = spark.createDataFrame([("l", "w99", "warc_signal_11")], "log string, warc_path string, error string")
    begun = spark.createDataFrame([("l", 10, 5)], "log string, init_ms long, jitter_ms long")
    text = render.timing_summary(done, failed, begun, top=2)
    assert "- Files read: 12" in text and "warc_signal_11" in text and "Processing takes 60.0 %" in text
    assert text.index("w12") < text.index("w11") and "w10 " not in text.split("Slowest")[1]
    with pytest.raises(ValueError, match="no file"):
        render.timing_summary(done.limit(0), failed, begun)


def test_made_up_facts_give_a_report(spark, tmp_path):
    now = F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))
    made = mock.feeds(spark, 400, now)
    links = mock.links(spark, 400, 300)
    assert discovery.several(links).count() > 10 and links.select("page_url").distinct().count() == 300
    described = mock.pages(spark, links, 100)
    facts = {"feeds": made, "links": links, "pages": described, "page_types": spark.createDataFrame([("text/html",)], "content_type string"), "counters": mock.counters(described, made, now)}
    out = survey.report(facts, "Made up", str(tmp_path / "r.html"))
    page = out[str(tmp_path / "r.html")]
    assert 'id="data-quality_by_format"' in page and '"columns": ["format"' in page
    assert "## Discovery" in out[str(tmp_path / "r.md")]


def test_long_tables_say_what_they_leave_out(spark):
    frame = spark.range(1, 251).select(F.concat(F.lit("l"), F.col("id")).alias("language"), F.col("id").alias("n"))
    rows = render.collected({"languages": frame})["languages"][1]
    assert [r[1] for r in rows[:-1]] == list(range(250, 150, -1)) and rows[-1] == ("(150 more)", None)
