"""Fetching URLs as schema.RESPONSES, some at a time in each task, with a fetcher that can be replaced."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .warc import batches

#: Seconds, bytes and threads.
TIMEOUT, MOST, AT_ONCE = 20.0, 10 << 20, 32

#: url -> status, headers (lower-case keys), body.
Fetcher = Callable[[str], tuple[int, dict[str, str], bytes]]


class ResponseTooLarge(ValueError):
    pass


def get(url: str, timeout: float = TIMEOUT, most: int = MOST) -> tuple[int, dict[str, str], bytes]:
    """A plain GET; `most` 0 is no limit."""
    with urlopen(Request(url, headers={"User-Agent": "syndilake"}), timeout=timeout) as answer:  # noqa: S310
        body = answer.read(most + 1 if most else -1)
        if most and len(body) > most:
            raise ResponseTooLarge(url)
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, body


def _row(url: str, fetcher: Fetcher) -> dict:
    row = dict.fromkeys(schema.RESPONSES.fieldNames()) | {"record_type": "response", "url": url, "warc_date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    try:
        status, headers, body = fetcher(url)
    except Exception as failure:  # noqa: BLE001  a URL's failure is its row
        return row | {"error": type(failure).__name__}
    return row | {"http_status": status, "http_headers": list(headers.items()), "body": body}


def fetched(urls: DataFrame, fetcher: Fetcher = get, tasks: int = 8, at_once: int = AT_ONCE, source: str | None = None) -> DataFrame:
    """A response for each distinct `url`; failures are rows with `error`."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in found:
                yield from batches(iter(pool.map(lambda u: _row(u, fetcher), batch.column(0).to_pylist())))

    rows = urls.select("url").filter(F.coalesce("url", F.lit("")) != "").distinct().repartition(tasks)
    return rows.mapInArrow(run, schema.RESPONSES).withColumn("candidate_source", F.lit(source))
