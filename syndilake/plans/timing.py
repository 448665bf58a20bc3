"""Sums and ranks of task timings read from logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent


def nearest_rank(rows: DataFrame, value: str, p: int) -> DataFrame:
    """The value at place n * p / 100, rounded down, from 1 on, in order: ranks by counts of values, over the files of a crawl."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.orderBy(value))
    whole = F.sum("c").over(Window.partitionBy())
    place = F.greatest(F.lit(1), F.floor(whole * p / 100))
    return each.withColumns({"_b": below, "_p": place}).filter(F.col("_b") >= F.col("_p")).agg(F.min(value).alias(f"p{p}"))


def metric(rows: DataFrame, value: str) -> DataFrame:
    """n, total, mean, median, p90, longest of a column of milliseconds."""
    own = rows.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.round(F.avg(value), 3).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("longest"))
    return own.crossJoin(nearest_rank(rows, value, 90)).select(F.lit(value).alias("metric"), "n", "total", "mean", "median", "p90", "longest")  # one row each


def slowest(warcs: DataFrame, n: int = 10) -> DataFrame:
    return warcs.orderBy(F.desc("total_ms"), "warc_path").limit(n)


def shares(warcs: DataFrame) -> DataFrame:
    """Part of the time that goes to processing, and to reading."""
    sums = warcs.agg(F.sum("total_ms").alias("total"), F.sum("process_ms").alias("process"), F.sum("iterator_ms").alias("iterator"), F.sum("records").alias("records"))
    return sums.select("*", percent(F.col("process"), F.col("total")).alias("process_pct"), percent(F.col("iterator"), F.col("total")).alias("iterator_pct"))


def failures(rows: DataFrame) -> DataFrame:
    """Failed reads by cause."""
    return rows.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error")
