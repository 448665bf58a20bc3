"""Platform fingerprints of headers, generators and pages as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .content import MARKED_BYTES, marked_head

#: Fixed values. Patterns with a dot are found anywhere, others as words of a-z and 0-9.
PATTERNS = {
    "blogger": ("blogger", "blogspot"), "drupal": ("drupal",), "feedburner": ("feedburner",), "ghost": ("ghost",), "joomla": ("joomla",),
    "medium": ("medium",), "shopify": ("shopify",), "squarespace": ("squarespace",), "substack": ("substack",), "wordpress": ("wordpress", "wp.com"),
}
#: Bytes of pages that give a platform away, and headers that name one.
MARKERS = {
    "drupal": ("/sites/default/files/", "drupal-settings-json"), "ghost": ("ghost/content/", "ghost.org"), "shopify": ("cdn.shopify.com", "shopify.theme"),
    "squarespace": ("static1.squarespace.com", "squarespace-cdn.com"), "substack": ("substackcdn.com", "substack.com"),
    "wix": ("static.wixstatic.com", "wix-code-sdk"), "wordpress": ("/wp-content/", "/wp-includes/"),
}
HEADERS = ("server", "x-generator", "x-powered-by", "x-drupal-cache", "x-drupal-dynamic-cache")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once; in what functions of arrays are given, Spark computes each mention of it anew."""
    return F.get(F.transform(F.array(value), then), 0)


def _labels(tests: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(label)) for label, test in tests.items()))))


def _named(value: Column, patterns: tuple[str, ...]) -> Column:
    words = [p for p in patterns if "." not in p]
    out = value.rlike(f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)") if words else F.lit(False)
    for p in patterns:
        if "." in p:
            out = out | value.contains(p)
    return out


def of_value(value: Column) -> Column:
    """Sorted labels of the platforms that a value names."""
    return _once(F.lower(F.coalesce(value, F.lit(""))), lambda low: _labels({label: _named(low, patterns) for label, patterns in PATTERNS.items()}))


def header(headers: Column, name: str) -> Column:
    """A header's value, or empty; keys are in lower case."""
    return F.coalesce(F.try_element_at(headers, F.lit(name.lower())), F.lit(""))


def of_headers(headers: Column) -> Column:
    """Labels of the headers that name platforms. Values are tested apart: a line end can't be part of one."""
    return of_value(F.array_join(F.array(*(header(headers, h) for h in HEADERS)), "\n"))


def of_html(html: Column) -> Column:
    """Labels by <meta name="generator"> in any order of attributes, and by bytes of the page's head."""
    return _once(marked_head(html), _of_head)


def _of_head(head: Column) -> Column:
    behind = F.slice(F.split(head, r"<meta(?=\s)"), 2, MARKED_BYTES)
    tags = F.transform(F.filter(behind, lambda t: t.contains(">")), lambda t: F.substring_index(t, ">", 1))
    attribute = lambda t, name: F.regexp_extract(t, rf"(?<=[\s'\"]){name}\s*=\s*(?:'([^']*)'|\"([^\"]*)\")", 0)
    value = lambda t, name: F.regexp_replace(attribute(t, name), r"^[^'\"]*['\"]|['\"]$", "")
    contents = F.transform(F.filter(tags, lambda t: value(t, "name") == "generator"), lambda t: value(t, "content"))
    named = of_value(F.array_join(contents, "\n"))
    marked = {label: F.lit(False) for label in MARKERS}
    for label, parts in MARKERS.items():
        for p in parts:
            marked[label] = marked[label] | head.contains(p)
    return F.array_sort(F.array_union(named, _labels(marked)))


def or_unknown(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unknown")))
