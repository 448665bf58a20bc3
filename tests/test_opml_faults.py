"""OPML with faults in the middle."""

from __future__ import annotations

import pytest

from syndilake.sources import lists

FAULTS = [
    '<outline xmlUrl="http://e.org/b?a=1&b=2"/>', '<outline title="x &nbsp; y" xmlUrl="http://e.org/b?a=1&amp;b=2"/>', '<outline xmlUrl="http://e.org/b?a=1&amp;b=2" xmlUrl="http://e.org/no"/>',
    '</other><outline xmlUrl="http://e.org/b?a=1&amp;b=2">', "<outline bare xmlUrl=http://e.org/b?a=1&b=2 />", '<outline text="a > b" xmlUrl="http://e.org/b?a=1&b=2"', "\x01<outline xmlUrl='http://e.org/b?a=1&#38;b=2'/>",
]


@pytest.mark.parametrize("fault", FAULTS)
def test_entries_behind_a_fault(fault):
    text = f'<?xml version="1.0"?><opml><body><outline xmlUrl="http://e.org/a"/><!-- <outline xmlUrl="no"/> -->{fault}\n<outline text="C" XMLURL="http://e.org/c"/></body></opml>'
    got = lists.outlines(text.encode())
    assert [r["feed_url"] for r in got] == ["http://e.org/a", "http://e.org/b?a=1&b=2", "http://e.org/c"]
    assert got[2]["title"] == "C" and [r["pos"] for r in got] == [0, 1, 2]


def test_opml_query_reads_on(spark):
    files = spark.createDataFrame([("x", b'<opml><outline xmlUrl="http://e.org/?a=1&b=2"/><outline xmlUrl="http://e.org/z"/></opml>')], "path string, content binary")
    assert {r.feed_url for r in lists.opml(files).collect()} == {"http://e.org/?a=1&b=2", "http://e.org/z"}
