"""Histograms and cumulative shares over fixed or natural bins, as conditional sums; bins without rows are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import percent

#: Fixed values: (largest value, label) of bins for whole numbers; the last has no end.
DISCOVERY = [(k, str(k)) for k in range(11)] + [(15, "11-15"), (20, "16-20"), (50, "21-50"), (100, "51-100"), (None, "100+")]
ENTRIES = [(k, str(k)) for k in range(11)] + [(15, "11-15"), (20, "16-20"), (30, "21-30"), (50, "31-50"), (100, "51-100"), (None, "100+")]
LOG = [(99, "0-100"), (499, "100-500"), (999, "500-1k"), (4_999, "1k-5k"), (9_999, "5k-10k"), (49_999, "10k-50k"), (99_999, "50k-100k"), (499_999, "100k-500k"), (None, "500k+")]
NATURAL = [(0, "0"), (127, "-127"), (254, "-254"), (511, "-511"), (1_023, "-1023")]
#: Days and names of the points of cumulative shares.
RECENCY = [(0, "Today"), (1, "1 day"), (3, "3 days"), (7, "1 week"), (14, "2 weeks"), (30, "1 month"), (90, "3 months"), (180, "6 months"), (365, "1 year"), (730, "2 years"), (10_000, "All")]
CADENCE = [(0.5, "12 hours"), (1, "1 day"), (2, "2 days"), (7, "1 week"), (14, "2 weeks"), (30, "1 month"), (90, "3 months"), (365, "1 year"), (10_000, "All")]


def _placed(value: Column, bins: Sequence[tuple[float | None, str]]) -> Column:
    out = None
    for k, (most, _) in enumerate(bins):
        test = F.lit(True) if most is None else value <= most
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def binned(rows: DataFrame, value: str, bins: Sequence[tuple[float | None, str]], weight: str | None = None) -> DataFrame:
    """place, label, n for every bin; rows beyond the last end, if it has one, are in none."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    found = rows.filter(F.col(value).isNotNull()).groupBy(_placed(F.col(value), bins).cast("int").alias("place")).agg(n.alias("n"))
    spine = rows.sparkSession.createDataFrame([(k, label) for k, (_, label) in enumerate(bins)], "place int, label string")
    return F.broadcast(spine).join(found, "place", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


def discovery_histogram(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    return binned(rows, value, DISCOVERY, weight)


def entry_histogram(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    return binned(rows, value, ENTRIES, weight)


def log_histogram(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    return binned(rows, value, LOG, weight)


def natural_histogram(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Bins that double: to 1,023, then to the power of two above the largest value. One pass finds the largest."""
    most = rows.agg(F.max(value)).first()[0] or 0
    bins, at = list(NATURAL), 1_024
    while at <= most:
        bins.append((2 * at - 1, f"-{2 * at // 1024}k"))
        at *= 2
    return binned(rows, value, bins, weight)


def simple_histogram(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """low, label, n of the bins that have rows; a bin is a tenth of the largest value wide."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    each = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(n.alias("n"))
    width = rows.agg(F.greatest(F.lit(1), F.floor(F.max(F.col(value).cast("long")) / 10)).cast("long").alias("_w"))
    each = each.crossJoin(F.broadcast(width))  # one row
    low = (F.floor(F.col("v") / F.col("_w")) * F.col("_w")).cast("long")
    each = each.withColumn("low", low).withColumn("_high", F.col("low") + F.col("_w") - 1)
    name = F.when(F.col("low") == F.col("_high"), F.col("low").cast("string"))
    name = name.when(F.col("_high") >= 1_024, F.concat(F.lit("-"), F.floor(F.col("_high") / 1_024).cast("string"), F.lit("k")))
    name = name.otherwise(F.concat(F.lit("-"), F.col("_high").cast("string")))
    return each.groupBy("low", name.alias("label")).agg(F.sum("n").alias("n")).orderBy("low")


def hundreds(feeds: DataFrame, lengths: str = "content_lengths") -> DataFrame:
    """Lengths of contents and summaries in bins of 100 characters."""
    each = feeds.select(F.explode(lengths).alias("v"))
    return each.groupBy((F.floor(F.col("v") / 100) * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(rows: DataFrame, value: Column, points: Sequence[tuple[float, str]]) -> DataFrame:
    """place, label, n (rows up to the point), known, pct, missing: one aggregation, then a row for each point."""
    known = F.count(value)
    sums = rows.agg(F.count(F.lit(1)).alias("_all"), known.alias("known"), *(F.count(F.when(value <= p, 1)).alias(f"_{k}") for k, (p, _) in enumerate(points)))
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("label"), F.col(f"_{k}").alias("n")) for k, (_, name) in enumerate(points)))
    out = sums.select(F.explode(each).alias("p"), "known", (F.col("_all") - F.col("known")).alias("missing"))
    return out.select("p.place", "p.label", "p.n", "known", percent(F.col("p.n"), F.col("known")).alias("pct"), "missing").orderBy("place")


def recency(feeds: DataFrame, date: str, now: Column) -> DataFrame:
    """Shares of dated feeds by whole days of age."""
    return cumulative(feeds, F.floor(dates.age_days(F.col(date), now)), RECENCY)


def cadence(feeds: DataFrame) -> DataFrame:
    return cumulative(feeds, F.col("update_cadence_days"), CADENCE)
