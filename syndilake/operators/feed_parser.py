"""RSS 1.0, RSS 2.0 and Atom, read off their bytes: one struct for each document, by one pass of expat.

Rules say what an element means by its dialect, its place (in an entry or not) and its name. Only bytes and free-form
dates need Python; what follows from the struct is left to column expressions.
"""

from __future__ import annotations

import re
from calendar import timegm
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from dateutil import parser as free_form
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..functions.text import CORE_NAMESPACES
from .batches import pieces

ATOM, DC, CONTENT = "http://www.w3.org/2005/Atom", "http://purl.org/dc/elements/1.1/", "http://purl.org/rss/1.0/modules/content/"
XML_LANG = "http://www.w3.org/XML/1998/namespace lang"
#: What free-form dates leave out is filled from here; nothing depends on today.
UNSTATED = datetime(2000, 1, 1)
_SPACE = " \t\r\n"


def epoch(text: str | None) -> int | None:
    """Seconds of a free-form date, UTC if it names no zone; none if it can't be read."""
    if not text or not text.strip():
        return None
    try:
        found = free_form.parse(text.strip(), default=UNSTATED)
        return timegm(found.astimezone(UTC).timetuple() if found.tzinfo else found.timetuple())
    except (ValueError, OverflowError, TypeError, AttributeError):
        return None


def atom_kind(kind: str | None) -> str:
    return {"html": "html", "text/html": "html", "xhtml": "xhtml", "application/xhtml+xml": "xhtml"}.get((kind or "").strip().lower(), "plain")


def text_kind(text: str) -> str:
    return "html" if "<" in text and ">" in text else "plain"


class Element:
    __slots__ = ("attributes", "length", "local", "ns", "parts", "plain")

    def __init__(self, ns: str, local: str, attributes: dict[str, str]) -> None:
        self.ns, self.local, self.attributes = ns, local, attributes
        #: Text before the first child; characters of all nested text; no child yet.
        self.parts, self.length, self.plain = [], 0, True

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Document:
    """What a feed says, gathered as its elements end."""

    def __init__(self) -> None:
        self.format = ""
        self.title = self.link = self.other_link = self.generator = self.language = ""
        self.entries = 0
        self.has_summary = self.has_content = False
        self.entry_languages: set[str] = set()
        self.languages: set[str] = set()
        self.hreflangs: set[str] = set()
        self.kinds: set[str] = set()
        self.extensions: set[tuple[str, str]] = set()
        self.lengths: list[int] = []
        self.titles: list[str] = []
        self.links: list[str] = []
        self.rels: dict[str, int] = {}
        self.updated: tuple[int | None, bool] = (None, False)
        self.entry_date: tuple[int | None, bool] = (None, False)
        self.dates: list[int] = []

    def first(self, name: str, value: str, lower: bool = False) -> None:
        if not getattr(self, name):
            setattr(self, name, value.strip().lower() if lower else value.strip())

    def dated(self, name: str, text: str, preferred: bool) -> None:
        """A date from the preferred element always counts; another does unless there is one from the preferred."""
        seconds = epoch(text)
        known, was_preferred = getattr(self, name)
        if seconds is not None and (preferred or known is None or not was_preferred):
            setattr(self, name, (seconds, preferred))

    def first_date(self, name: str, text: str) -> None:
        if getattr(self, name)[0] is None:
            setattr(self, name, (epoch(text), False))

    def sample(self, element: Element, kind: str) -> None:
        self.kinds.add(kind)
        if element.length:
            self.lengths.append(element.length)

    def atom_link(self, element: Element) -> None:
        self.hreflang(element)
        href = element.attributes.get("href", "")
        rel = (element.attributes.get("rel") or "alternate").strip().lower()
        if not href:
            return
        for token in rel.split():
            self.rels[token] = self.rels.get(token, 0) + 1
        if rel in ("", "alternate") and not self.link:
            self.link = href
        elif not self.other_link and rel != "self":
            self.other_link = href

    def hreflang(self, element: Element) -> None:
        if value := element.attributes.get("hreflang", "").strip().lower():
            self.hreflangs.add(value)

    def entry_language(self, text: str) -> None:
        if value := text.strip().lower():
            self.languages.add(value)
            self.entry_languages.add(value)

    def channel_language(self, element: Element) -> None:
        self.first("language", element.attributes.get(XML_LANG, ""), lower=True)

    def summary(self, element: Element, kind: str) -> None:
        self.has_summary = True
        self.sample(element, kind)

    def content(self, element: Element, kind: str) -> None:
        self.has_content = True
        self.sample(element, kind)


Rule = Callable[[Document, Element], None]
#: By dialect: rules outside and inside of entries. A namespace of None stands for any.
_LANGUAGE: dict = {(DC, "language"): lambda d, e: d.first("language", e.text, lower=True)}
_TITLED: dict = {"title": lambda d, e: d.first("title", e.text)}
_MADE: dict = {"generator": lambda d, e: d.first("generator", e.text)}
OUTSIDE: dict[str, dict[tuple[str | None, str], Rule]] = {
    "atom": {
        **{(ATOM, k): v for k, v in (_TITLED | _MADE).items()},
        (ATOM, "link"): Document.atom_link,
        (ATOM, "updated"): lambda d, e: d.dated("updated", e.text, True),
        (ATOM, "published"): lambda d, e: d.dated("updated", e.text, False),
        **_LANGUAGE,
    },
    "rss": {
        **{("", k): v for k, v in (_TITLED | _MADE).items()},
        ("", "link"): lambda d, e: d.first("link", e.text),
        ("", "lastBuildDate"): lambda d, e: d.dated("updated", e.text, True),
        ("", "pubDate"): lambda d, e: d.dated("updated", e.text, False),
        (DC, "date"): lambda d, e: d.dated("updated", e.text, False),
        ("", "language"): lambda d, e: d.first("language", e.text, lower=True),
        ("", "channel"): Document.channel_language,
        (ATOM, "link"): Document.atom_link,
        **_LANGUAGE,
    },
    "rdf": {
        **{(None, k): v for k, v in _TITLED.items()},
        (None, "link"): lambda d, e: d.first("link", e.text),
        (None, "channel"): Document.channel_language,
        (DC, "date"): lambda d, e: d.first_date("updated", e.text),
        **_LANGUAGE,
    },
}
_IN_ENTRY: dict = {
    (DC, "date"): lambda d, e: d.first_date("entry_date", e.text),
    (DC, "language"): lambda d, e: d.entry_language(e.text),
    (CONTENT, "encoded"): lambda d, e: d.content(e, "html"),
}
_NAMED: dict = {
    "title": lambda d, e: d.titles.append(e.text),
    "link": lambda d, e: d.links.append(e.text),
    "description": lambda d, e: d.summary(e, text_kind(e.text)),
}


def _entry_link(document: Document, element: Element) -> None:
    document.hreflang(element)
    document.links.append(element.attributes.get("href", ""))


INSIDE: dict[str, dict[tuple[str | None, str], Rule]] = {
    "atom": {
        (ATOM, "updated"): lambda d, e: d.dated("entry_date", e.text, True),
        (ATOM, "published"): lambda d, e: d.dated("entry_date", e.text, False),
        (ATOM, "title"): lambda d, e: d.titles.append(e.text),
        (ATOM, "link"): _entry_link,
        (ATOM, "content"): lambda d, e: d.content(e, atom_kind(e.attributes.get("type"))),
        (ATOM, "summary"): lambda d, e: d.summary(e, atom_kind(e.attributes.get("type"))),
    },
    "rss": {**{("", k): v for k, v in _NAMED.items()}, ("", "pubDate"): lambda d, e: d.first_date("entry_date", e.text), **_IN_ENTRY},
    "rdf": {**{(None, k): v for k, v in _NAMED.items()}, **_IN_ENTRY},
}
#: Elements that are entries.
ENTRY: dict[str, tuple[str | None, str]] = {"atom": (ATOM, "entry"), "rss": ("", "item"), "rdf": (None, "item")}


class Refused(Exception):
    """The document isn't a feed, or asks for what isn't done."""


#: Encodings that expat reads itself.
_OWN = frozenset({"utf-8", "utf8", "utf-16", "utf-16le", "utf-16be", "iso-8859-1", "us-ascii", "ascii"})
_DECLARED = re.compile(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)")


def recoded(body: bytes) -> tuple[bytes, str | None]:
    """The body, and UTF-8 if it was turned into that: documents that declare an encoding which expat doesn't read.

    As for any XML the declaration counts, not the HTTP header. Bytes that the encoding doesn't have are a ValueError.
    """
    said = _DECLARED.match(body)
    name = said[1].decode().lower() if said else "utf-8"
    if name in _OWN:
        return body, None
    return body.decode(name).encode("utf-8", "surrogatepass"), "utf-8"


class Reader:
    def __init__(self, encoding: str | None = None) -> None:
        self.document = Document()
        self.dialect = ""
        self.open: list[Element] = []
        self.entry_depth = 0
        self.expat = expat.ParserCreate(encoding, namespace_separator=" ")
        self.expat.buffer_text = True
        self.expat.StartElementHandler, self.expat.EndElementHandler, self.expat.CharacterDataHandler = self.start, self.end, self.text
        self.expat.EntityDeclHandler = self.entity

    def entity(self, *_: object) -> None:
        raise Refused("Entity declaration")

    def root(self, element: Element) -> None:
        lang = element.attributes.get(XML_LANG, "").strip().lower()
        self.document.language = lang
        if element.local == "feed" and element.ns in (ATOM, ""):
            self.dialect, self.document.format = "atom", "atom10"
        elif element.local == "rss":
            self.dialect, self.document.format = "rss", f"rss{element.attributes.get('version', '2.0')}"
        elif element.local == "RDF":
            self.dialect, self.document.format = "rdf", "rss10"
        else:
            raise Refused(f"Unknown root tag: {element.local}")

    def start(self, name: str, attributes: dict[str, str]) -> None:
        ns, _, local = name.rpartition(" ")
        element = Element(ns, local, attributes)
        if self.open:
            self.open[-1].plain = False
        else:
            self.root(element)
        self.open.append(element)
        wanted = ENTRY[self.dialect]
        if len(self.open) > 1 and local == wanted[1] and wanted[0] in (None, ns):
            self.document.entries += 1
            self.document.entry_date = (None, False)
            self.entry_depth = len(self.open)
        if lang := attributes.get(XML_LANG, "").strip().lower():
            self.document.languages.add(lang)
            if self.entry_depth:
                self.document.entry_languages.add(lang)

    def text(self, text: str) -> None:
        if self.open[-1].plain:
            self.open[-1].parts.append(text)
        self.open[-1].length += len(text)

    def end(self, _: str) -> None:
        element, depth = self.open.pop(), len(self.open) + 1
        document = self.document
        if self.open:
            self.open[-1].length += element.length
        if element.ns and element.ns not in CORE_NAMESPACES:
            document.extensions.add((element.ns, element.local))
        wanted = ENTRY[self.dialect]
        if self.entry_depth and depth > 1 and element.local == wanted[1] and wanted[0] in (None, element.ns):
            self.entry_depth = 0
            if document.entry_date[0] is not None:
                document.dates.append(document.entry_date[0])
            return
        rules = (INSIDE if self.entry_depth else OUTSIDE)[self.dialect]
        rule = rules.get((element.ns, element.local)) or rules.get((None, element.local))
        if rule:
            rule(document, element)


_NOTHING = dict.fromkeys(schema.PARSED.fieldNames())


def parse(body: bytes | None) -> dict:
    """A dict for schema.PARSED; `error` says why a document isn't a feed, and `error_type` what kind of reason that is."""
    if not body:
        return _NOTHING | {"error": "Empty response", "error_type": "Empty response"}
    start = body.lstrip()[:1]
    if start not in (b"<", b"\xef") and body[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return _NOTHING | {"error": "Not XML", "error_type": "Not XML"}
    try:
        body, encoding = recoded(body)
        reader = Reader(encoding)
        reader.expat.Parse(body, True)
    except Refused as refused:
        return _NOTHING | {"error": str(refused), "error_type": str(refused)}
    except expat.ExpatError as broken:
        reason = expat.errors.messages.get(broken.code, "ParseError")
        return _NOTHING | {"error": f"{reason}: line {broken.lineno}, column {broken.offset}", "error_type": reason}
    except (ValueError, LookupError) as broken:
        return _NOTHING | {"error": str(broken), "error_type": type(broken).__name__}
    d = reader.document
    return {
        "error": None, "error_type": None, "format": d.format, "entries_count": d.entries, "title": d.title or None, "link": d.link or d.other_link or None,
        "feed_generator": d.generator or None, "lang_feed": d.language or None, "lang_entries": sorted(d.entry_languages), "all_languages": sorted(d.languages),
        "hreflang_values": sorted(d.hreflangs), "has_summary": d.has_summary, "has_content": d.has_content, "content_types": sorted(d.kinds),
        "content_lengths": d.lengths, "extensions": [{"ns": a, "local": b} for a, b in sorted(d.extensions)], "updated": d.updated[0],
        "newest": max(d.dates, default=None), "oldest": min(d.dates, default=None), "entry_titles": d.titles, "entry_links": d.links, "feed_links": list(d.rels.items()),
    }


def structs(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches with the struct in place of their last column, the bodies, a piece at a time."""
    for batch in batches:
        bodies = batch.column(batch.num_columns - 1)
        for start, end in pieces(bodies):
            found = pa.array([parse(bodies[k].as_py()) for k in range(start, end)], type=arrow.field("parsed").type)
            kept = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*(kept.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns - 1)), found], schema=arrow)


def parsed(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses with the struct `parsed` in place of the body. Rows without a body get the error for it."""
    kept = [c for c in responses.columns if c != body]
    out = responses.select(*kept, F.col(body).cast("binary").alias("_body"))
    target = T.StructType([*(f for f in out.schema.fields if f.name != "_body"), T.StructField("parsed", schema.PARSED)])
    arrow = to_arrow_schema(target)
    return out.mapInArrow(lambda batches: structs(batches, arrow), target)


def parsed_column(body: Column) -> Column:
    """The struct as a column, for streams and ad-hoc queries."""
    @F.pandas_udf(schema.PARSED)
    def each(bodies: pd.Series) -> pd.DataFrame:
        rows = [parse(x) for x in bodies]
        return pd.DataFrame(rows, columns=schema.PARSED.fieldNames())

    return each(body.cast("binary"))
