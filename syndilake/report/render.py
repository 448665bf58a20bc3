"""Markdown and HTML of small tables. Only a report's rows, not the facts behind them, reach the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import timing

#: Sections of the report: heading, and the tables under it.
SECTIONS: Sequence[tuple[str, Sequence[str]]] = (
    ("Overview", ("totals", "families", "sites")),
    ("Freshness", ("entry_recency", "feed_recency", "discovered_recency")),
    ("Quality", ("quality", "quality_histogram", "quality_by_format", "quality_split")),
    ("Formats and errors", ("formats", "charsets", "sniffed", "errors")),
    ("Content", ("entries", "lengths", "profiles", "profile_prevalence")),
    ("Languages", ("languages", "language_counts", "language_prevalence")),
    ("Extensions", ("extension_prevalence",)),
    ("Platforms", ("platform_prevalence", "source_quality", "page_platforms")),
    ("Links and cadence", ("signal_prevalence", "cadence")),
    ("Discovery", ("discovery", "pages_with_links", "links_per_page", "feeds_per_site", "format_pairs")),
    ("Media types", ("content_types",)),
)
#: Most rows of a table; a longer one has its largest, and a row that says how many are left out.
ROWS = 100


def shown(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return ", ".join(map(shown, value)) if isinstance(value, list | tuple) else str(value)


def cell(value: object) -> str:
    """A cell of a Markdown table: no bars, no line ends."""
    return shown(value).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(headers: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A Markdown table with columns of even width."""
    lines = [[cell(x) for x in row] for row in rows]
    widths = [max(3, *(len(row[k]) for row in [list(headers), *lines])) for k in range(len(headers))]
    draw = lambda row: "| " + " | ".join(x.ljust(w) for x, w in zip(row, widths)) + " |"
    return "\n".join([draw(list(headers)), "| " + " | ".join("-" * w for w in widths) + " |", *map(draw, lines)])


def collected(tables: Mapping[str, DataFrame]) -> dict[str, tuple[list[str], list[tuple]]]:
    """Columns and rows of the tables that sections show."""
    wanted = [name for _, names in SECTIONS for name in names if name in tables]
    return {name: (tables[name].columns, _rows(tables[name])) for name in wanted}


def _rows(frame: DataFrame) -> list[tuple]:
    """All rows in their order, if they are ROWS at most; else those with the largest n, by label."""
    rows = [tuple(r) for r in frame.limit(ROWS + 1).collect()]
    if len(rows) <= ROWS:
        return rows
    columns = frame.columns
    order = [F.desc(c) for c in ("n", "feeds", "pages") if c in columns][:1] + [F.col(c) for c in columns]
    left = frame.count() - ROWS
    return [*(tuple(r) for r in frame.orderBy(*order).limit(ROWS).collect()), (f"({left:,} more)", *[None] * (len(columns) - 1))]


def halves(rows: Sequence[Sequence[object]]) -> list[list[object]]:
    """Rows in two columns: the first half beside the second."""
    half = -(-len(rows) // 2)
    blank = [""] * (len(rows[0]) if rows else 0)
    return [[*rows[k], *(rows[half + k] if half + k < len(rows) else blank)] for k in range(half)]


def title(label: str) -> str:
    return label.replace("_", " ").capitalize()


def markdown(heading: str, data: Mapping[str, tuple[list[str], list[tuple]]]) -> str:
    out = [f"# {heading}"]
    for section, names in SECTIONS:
        own = [n for n in names if n in data]
        if own:
            out.append(f"## {section}")
        for name in own:
            columns, rows = data[name]
            out.append(f"### {title(name)}")
            if not rows:
                out.append("Nothing was found.")
            elif name == "errors":
                out.append(table([*columns, *columns], halves(rows)))
            else:
                out.append(table(columns, rows))
    return "\n\n".join(out) + "\n"


def page(heading: str, data: Mapping[str, tuple[list[str], list[tuple]]]) -> str:
    """A plain HTML page with the same tables, and each table's rows as JSON for whoever draws charts of them."""
    esc = lambda x: html.escape(shown(x))
    out = [f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{html.escape(heading)}</title></head><body><h1>{html.escape(heading)}</h1>"]
    for section, names in SECTIONS:
        own = [n for n in names if n in data]
        if own:
            out.append(f"<h2>{section}</h2>")
        for name in own:
            columns, rows = data[name]
            body = "".join("<tr>" + "".join(f"<td>{esc(x)}</td>" for x in r) + "</tr>" for r in rows)
            out.append(f"<h3>{title(name)}</h3><table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in columns) + f"</tr>{body}</table>")
            payload = json.dumps({"columns": columns, "rows": rows}, default=str).replace("<", "\\u003c")
            out.append(f'<script type="application/json" id="data-{html.escape(name)}">{payload}</script>')
    return "\n".join(out) + "</body></html>\n"


def beside(path: str) -> str:
    """Where the Markdown of an HTML report goes."""
    return str(PurePath(path).with_suffix(".md"))


def opml_title(source: str) -> str:
    return f"OPML: {PurePath(source).name or source}"


def _seconds(milliseconds: float | None) -> str:
    return f"{(milliseconds or 0) / 1000:.1f}s"


def timing_summary(done: DataFrame, failed: DataFrame, begun: DataFrame, top: int = 10) -> str:
    """Markdown of task logs (sources.lists.logs): totals, failures, a table for files and one for starts, the slowest files."""
    whole = timing.shares(done).first()
    starts = begun.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    bad = [tuple(r) for r in failed.select("error", "warc_path", "log").orderBy("warc_path", "log").limit(ROWS).collect()]
    n, left = done.count(), failed.count()
    if not n:
        raise ValueError("the logs tell of no file that was read")
    out = ["# Timings", "\n".join([f"- Tasks: {starts:,}", f"- Files read: {n:,}", f"- Files that failed: {left:,}", f"- Records: {whole['records']:,}"])]
    if bad:
        out += ["## Failures", table(["Cause", "File", "Log"], bad + ([(f"({left - ROWS:,} more)", "", "")] if left > ROWS else []))]
    headers = ["Part", "Sum", "Mean", "Median", "90 %", "Longest"]

    def metrics(rows: DataFrame, parts: Mapping[str, str]) -> str:
        found = [(label, timing.metric(rows, column).first()) for column, label in parts.items()]
        return table(headers, [[label, *(_seconds(r[c]) for c in ("total", "mean", "median", "p90", "longest"))] for label, r in found])

    out += ["## Files", metrics(done, {"total_ms": "whole", "process_ms": "processing", "iterator_ms": "reading"}), f"Processing takes {whole['process_pct']} % of the time."]
    out += ["## Starts", metrics(begun, {"init_ms": "setting up", "jitter_ms": "waiting"})]
    slow = [[_seconds(r["total_ms"]), _seconds(r["process_ms"]), _seconds(r["iterator_ms"]), r["records"], r["warc_path"]] for r in timing.slowest(done, top).collect()]
    return "\n\n".join([*out, f"## Slowest {top}", table(["Whole", "Processing", "Reading", "Records", "File"], slow)]) + "\n"
