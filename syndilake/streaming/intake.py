"""Responses as a stream: routing and parsing are stateless; a watermark bounds what is remembered of URLs already seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feeds, routing


def records(responses: DataFrame, now: Column, late: str = "1 hour") -> DataFrame:
    """A stream of schema.FEEDS rows: the first response of each URL within `late` of the newest crawl date."""
    routes = routing.routed(responses.filter(F.coalesce("url", F.lit("")) != ""))
    own = routing.feed_responses(routes).withColumn("seen", F.coalesce(F.to_timestamp("warc_date"), now))
    once = own.withWatermark("seen", late).dropDuplicatesWithinWatermark(["url"])
    return feeds.records(once.drop("seen"), now)


def counts(responses: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Responses by route in windows of crawl time."""
    routes = routing.routed(responses).withColumn("seen", F.to_timestamp("warc_date")).withWatermark("seen", late)
    return routes.groupBy(F.window("seen", window).alias("time"), "route").count().select(F.col("time.start").alias("start"), "route", F.col("count").alias("n"))


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table, exactly once."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
