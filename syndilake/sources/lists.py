"""Lists: WARC paths, crawl identifiers, top sites, OPML subscriptions, result lines and task logs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..functions.url import normalize_url
from ..operators.batches import pieces
from ..operators.sites import with_site
from . import stores


def paths(spark: SparkSession, source: str, limit: int | None = None) -> DataFrame:
    """path, pos of a text file's lines, compressed or not; blank lines and comments are left out. The first `limit` if given."""
    lines = spark.read.text(source).select(F.trim("value").alias("path"), F.monotonically_increasing_id().alias("pos"))
    kept = lines.filter((F.col("path") != "") & ~F.col("path").startswith("#"))
    return kept.orderBy("pos").limit(limit) if limit is not None else kept


def latest_crawl(info: str) -> str:
    """Identifier of the first crawl of a list of crawls in JSON."""
    crawls = json.loads(info)
    if not crawls or not crawls[0].get("id"):
        raise ValueError("no crawl is listed")
    return crawls[0]["id"]


def first_csv(archive: bytes) -> bytes:
    """First .csv member of a zip archive."""
    with zipfile.ZipFile(io.BytesIO(archive)) as members:
        for name in members.namelist():
            if name.lower().endswith(".csv"):
                return members.read(name)
    raise ValueError("no .csv member")


def subdomains_listed(flag: str | None) -> bool:
    """Which flavour of the top list an environment's flag asks for."""
    return (flag or "").strip().lower() not in ("0", "false", "no", "standard")


def top_sites(spark: SparkSession, csv: str, n: int | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """rank, site of the first n lines of rank,domain; lines without exactly two fields and domains without a site drop out.

    The cut is by line and comes before sites are made distinct, so that there may be fewer than n.
    """
    lines = spark.read.text(csv).select("value", F.monotonically_increasing_id().alias("pos"))
    lines = lines.orderBy("pos").limit(n) if n is not None else lines
    fields = F.split(F.trim("value"), ",", -1)
    own = lines.filter(F.size(fields) == 2).select(F.get(fields, 0).try_cast("int").alias("rank"), F.get(fields, 1).alias("domain"))
    own = with_site(own, F.col("domain"), suffixes)
    return own.filter(F.col("site") != "").groupBy("site").agg(F.min("rank").alias("rank"))


def list_name(subdomains: bool, normalised: bool) -> str:
    """File name of a flavour of the top list: with subdomains or of registered domains alone, as it came or as sites."""
    return f"top-{'subdomains' if subdomains else 'domains'}{'-sites' if normalised else ''}{'' if normalised else '.csv'}"


def list_label(subdomains: bool) -> str:
    return "with subdomains" if subdomains else "registered domains alone"


def find_list(folders: list[str], subdomains: bool) -> tuple[str, bool] | None:
    """The first list of a flavour in the folders, and whether it's of sites; lists of sites in any folder come first."""
    for normalised in (True, False):
        for folder in folders:
            path = Path(folder) / list_name(subdomains, normalised)
            if path.exists():
                return str(path), normalised
    return None


def fetch_list(url: str, folder: str, subdomains: bool, opener: Callable[[str], BinaryIO] = stores.opened) -> str:
    """The list's CSV in a folder; downloaded, and taken out of its archive, unless it's there."""
    to = Path(folder) / list_name(subdomains, False)
    if not to.exists():
        to.parent.mkdir(parents=True, exist_ok=True)
        part = to.with_suffix(".part")
        archive = stores.download(url, str(part), opener)
        body = Path(archive).read_bytes()
        part.write_bytes(first_csv(body) if body[:2] == b"PK" else body)
        part.replace(to)
    return str(to)


def cached_sites(spark: SparkSession, raw: str, folder: str, subdomains: bool, suffixes: DataFrame | None = None) -> DataFrame:
    """pos, rank, site of the lines of a list, kept as a table in a folder; made anew if it's missing, older than the list, or has another number of lines."""
    path = Path(folder) / list_name(subdomains, True)
    lines = spark.read.text(raw).select("value", F.monotonically_increasing_id().alias("pos"))
    done = path / "_SUCCESS"
    if not done.exists() or done.stat().st_mtime < Path(raw).stat().st_mtime or spark.read.parquet(str(path)).count() != lines.count():
        fields = F.split(F.trim("value"), ",", -1)
        whole = F.size(fields) == 2
        own = with_site(lines.withColumn("domain", F.when(whole, F.get(fields, 1))), F.col("domain"), suffixes)
        own.select("pos", F.when(whole, F.get(fields, 0)).try_cast("int").alias("rank"), F.when(whole, F.col("site")).alias("site")).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def first_sites(sites: DataFrame, n: int | None = None) -> DataFrame:
    """rank, site of the first n lines of cached_sites(), as top_sites() has them."""
    rows = sites.orderBy("pos").limit(n) if n is not None else sites
    return rows.filter(F.coalesce("site", F.lit("")) != "").groupBy("site").agg(F.min("rank").alias("rank"))


#: Markup of faulty XML: what is skipped, or a start tag whose attributes follow.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<([^\s<>/!?=\"'&]+)", re.DOTALL)
_ATTRIBUTE = re.compile(r"[\s/]*([^\s<>/=\"']+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s<>\"']+))|[\s/]*[^\s<>/]|[\s/]+")
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#x([0-9A-Fa-f]{1,6})|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_SPACES = str.maketrans("\t\n\r", "   ")
_ENCODING = re.compile(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")


def _decoded(body: bytes) -> str:
    """By byte order mark, else by declaration, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    said = _ENCODING.match(body.lstrip())
    try:
        return body.decode(said[1].decode() if said else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _referred(m: re.Match) -> str:
    if m[3]:
        return _NAMED[m[3]]
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _tags(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Start tags with attributes of XML with faults: of repeated attributes the first counts, bare ampersands stay."""
    at = 0
    while m := _MARKUP.search(text, at):
        at = m.end()
        if m[1]:
            own: dict[str, str] = {}
            while a := _ATTRIBUTE.match(text, at):
                at = a.end()
                if a[1]:
                    value = next(x for x in a.groups()[1:] if x is not None)
                    own.setdefault(a[1], _REFERENCE.sub(_referred, value.translate(_SPACES)))
            yield m[1], own


def outlines(body: bytes | None) -> list[dict]:
    """Rows of schema.OPML_ENTRY, as they come; names of attributes in any case. A document with faults is read on behind them."""
    out: list[dict] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        if name.rpartition(" ")[2].rpartition(":")[2].lower() == "outline":
            own = {k.lower(): v.strip() for k, v in attributes.items()}
            if own.get("xmlurl"):
                out.append({"feed_url": own["xmlurl"], "html_url": own.get("htmlurl") or own.get("url") or None, "title": own.get("title") or own.get("text") or "", "pos": len(out)})

    reader = expat.ParserCreate()
    reader.StartElementHandler = start
    try:
        reader.Parse(body or b"", True)
    except (expat.ExpatError, ValueError, LookupError):  # the latter two: encodings that expat doesn't have
        out.clear()
        for name, attributes in _tags(_decoded(body or b"")):
            start(name, attributes)
    return out


def entries(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """path and the columns of schema.OPML_ENTRY for batches of path and document, a piece at a time."""
    for batch in batches:
        paths, bodies = batch.columns
        for start, end in pieces(bodies):
            rows = [{"path": paths[k].as_py(), **e} for k in range(start, end) for e in outlines(bodies[k].as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def opml(files: DataFrame, body: Column | None = None) -> DataFrame:
    """feed_url, html_url, title, pos: the first entry of each feed, in the documents' order. files: path, content.

    Python holds the entries of one piece of a batch at a time; entries are many times as large as their documents.
    """
    own = files.select("path", (body if body is not None else F.col("content")).alias("_body"))
    target = T.StructType([own.schema["path"], *schema.OPML_ENTRY.fields])
    arrow = to_arrow_schema(target)

    found = own.mapInArrow(lambda batches: entries(batches, arrow), target)
    found = found.withColumns({"feed_url": normalize_url(F.col("feed_url")), "html_url": F.when(F.col("html_url").isNotNull(), normalize_url(F.col("html_url")))})
    first = F.row_number().over(Window.partitionBy("feed_url").orderBy("path", "pos"))
    return found.withColumn("_n", first).filter("_n = 1").select("feed_url", "html_url", "title", "pos")


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    return opml(spark.read.format("binaryFile").load(path).select("path", "content"))


def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """label, key, data (JSON) of `"label"<tab>JSON` lines of part files; lines that aren't so are left out."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.option("pathGlobFilter", "part-*").text(folder).select(F.regexp_replace(F.get(parts, 0), '^"|"$', "").alias("label"), F.get(parts, 1).alias("data"))
    return rows.filter(F.col("data").isNotNull() & F.try_parse_json("data").isNotNull())


#: Patterns of the lines that tasks log.
_DONE = r"finished (\S+) total_ms=(\d+) process_ms=(\d+) iterator_ms=(\d+) records=(\d+)"
_FAILED = r"failed (\S+) (signal|exit)[ =](\d+)"
_BEGUN = r"init_ms=(\d+)(?: jitter_ms=(\d+))?"


def logs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Timings, failures and starts of tasks from the *stderr* files below a folder, compressed or not.

    Starts are those of files in which at least one WARC was finished.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*stderr*").text(folder).select("value", F.input_file_name().alias("log"))
    one = lambda p, k: F.regexp_extract("value", p, k)
    done = lines.filter(F.col("value").rlike(_DONE)).select("log", one(_DONE, 1).alias("warc_path"), *(one(_DONE, k).cast("long").alias(c) for k, c in ((2, "total_ms"), (3, "process_ms"), (4, "iterator_ms"), (5, "records"))))
    failed = lines.filter(F.col("value").rlike(_FAILED)).select("log", one(_FAILED, 1).alias("warc_path"), F.concat_ws("_", F.lit("warc"), one(_FAILED, 2), one(_FAILED, 3)).alias("error"))
    begun = lines.filter(F.col("value").rlike(_BEGUN)).select("log", one(_BEGUN, 1).cast("long").alias("init_ms"), F.coalesce(one(_BEGUN, 2).try_cast("long"), F.lit(0)).alias("jitter_ms"))
    return done, failed, begun.join(done.select("log").distinct(), "log", "left_semi")
