"""Media types, sniffing and classes of content as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of feeds; suffixes and parts of media types.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/xml+rss", "text/rss", "text/atom")
FEED_SUFFIXES = ("+rss", "+atom")
SNIFFABLE = ("xml", "text/plain", "application/octet-stream")
INTERESTING = ("text/html", "xml", "rss", "text/plain", "application/octet-stream")
LINK_TYPES = ("rss+xml", "atom+xml", "rdf+xml")
ATOM_NS, RSS1_NS = "http://www.w3.org/2005/Atom", "http://purl.org/rss/1.0/"
PROFILES = ("html", "plain", "xhtml", "mixed", "unknown")
COLLAPSED = ("HTML", "Atom", "RSS", "Other XML", "Other Non-XML")
HTML_BYTES, FEED_BYTES, SNIFFED_BYTES, MARKED_BYTES = 12_288, 10 << 20, 1_000, 32_768


def _any(column: Column, parts: tuple[str, ...], test: str = "contains") -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | getattr(column, test)(p)
    return out


def media_type(header: Column) -> Column:
    """Lower case, without parameters; null becomes empty."""
    return F.trim(F.substring_index(F.lower(F.coalesce(header, F.lit(""))), ";", 1))


def known_media_type(header: Column) -> Column:
    return F.when(media_type(header) == "", F.lit("unknown")).otherwise(media_type(header))


def charset(header: Column) -> Column:
    """Value of the last charset parameter, lower case and without quotes; else empty."""
    parts = F.slice(F.split(F.lower(F.coalesce(header, F.lit(""))), ";"), 2, 1 << 20)
    named = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.startswith("charset="))
    return F.coalesce(F.trim(F.regexp_replace(F.substring_index(F.get(named, F.size(named) - 1), "=", -1), '"', "")), F.lit(""))


def is_feed_type(kind: Column) -> Column:
    return kind.isin(*FEED_TYPES) | _any(kind, FEED_SUFFIXES, "endswith")


def is_sniffable(kind: Column) -> Column:
    return _any(kind, SNIFFABLE)


def is_interesting(header: Column) -> Column:
    return _any(F.lower(F.coalesce(header, F.lit(""))), INTERESTING)


def is_interesting_payload(header: Column) -> Column:
    """A payload type that is missing passes."""
    return header.isNull() | (header == "") | is_interesting(header)


def _head(body: Column, n: int) -> Column:
    """First bytes in lower case; all markers are ASCII, so Latin-1 finds them in any such encoding, cut or damaged."""
    return F.lower(F.decode(F.substring(body, 1, n), "ISO-8859-1"))


def sniff(body: Column) -> Column:
    """rss, atom, rdf or unknown by the first bytes."""
    head = _head(F.coalesce(body, F.lit(b"")), SNIFFED_BYTES)
    atom = head.contains("<feed") & head.contains(f'xmlns="{ATOM_NS.lower()}"')
    return F.when(head.contains("<rss"), "rss").when(atom, "atom").when(head.contains("<rdf") & head.contains(RSS1_NS), "rdf").otherwise("unknown")


def marked_head(html: Column) -> Column:
    return _head(F.coalesce(html, F.lit(b"")), MARKED_BYTES)


def atom_content_type(kind: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(low.isin("html", "text/html"), "html").when(low.isin("xhtml", "application/xhtml+xml"), "xhtml").otherwise("plain")


def text_content_type(text: Column) -> Column:
    return F.when(F.coalesce(text.contains("<") & text.contains(">"), F.lit(False)), "html").otherwise("plain")


def content_profile(kinds: Column) -> Column:
    """unknown, the one kind, or mixed."""
    own = F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>")))
    return F.when(F.size(own) == 0, "unknown").when(F.size(own) == 1, F.get(own, 0)).otherwise("mixed")


def collapsed_type(kind: Column) -> Column:
    """One of COLLAPSED, tested in that order."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(low.contains("text/html") | low.contains("application/xhtml"), "HTML")
        .when(low.contains("atom"), "Atom")
        .when(low.contains("rss"), "RSS")
        .when(low.contains("xml"), "Other XML")
        .otherwise("Other Non-XML")
    )
