"""Operational quality of feeds: sub-scores, their weighted sum under a cap, and summaries. Column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Fixed values.
WEIGHTS = {"recency": 0.35, "content_richness": 0.25, "entry_count": 0.15, "entry_metadata": 0.15, "feed_metadata": 0.10}
PROFILE_SCORES = {"html": 1.0, "xhtml": 1.0, "mixed": 0.75, "plain": 0.5}
HIGH_QUALITY, HIGH, MIDDLE = 0.5, 0.7, 0.4


def _c(name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def usable() -> Column:
    """Valid and without an error; an empty error is none."""
    return _c("valid", False) & (_c("error", "") == "")


def age(now: Column) -> Column:
    return dates.recency_age(F.col("newest_entry_date"), F.col("updated_date"), now)


def active(now: Column) -> Column:
    return usable() & F.coalesce(age(now) <= dates.CUTOFF, F.lit(False))


def _some(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def _flag(test: Column, points: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)


def components(now: Column) -> dict[str, Column]:
    """The five sub-scores; all 0 for a feed that isn't active."""
    lengths = F.coalesce("content_lengths", F.array().cast("array<int>"))
    mean = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(lengths)
    presence = F.when(_c("has_content", False), 1.0).when(_c("has_summary", False), 0.5).otherwise(0.0)
    length = F.when(F.size(lengths) > 0, F.least(mean / 1000.0, F.lit(1.0))).otherwise(0.0)
    profile = F.lit(0.1)
    for name, points in PROFILE_SCORES.items():
        profile = F.when(F.lower(_c("content_type_profile", "")) == name, points).otherwise(profile)
    titles, links = _c("repeated_entry_title_ratio", 0.0), _c("repeated_entry_link_ratio", 0.0)
    entry = _flag(F.col("newest_entry_date").isNotNull(), 0.40) + _flag(F.col("oldest_entry_date").isNotNull(), 0.20)
    entry = entry + _flag(_some("lang_entries"), 0.20) + _flag(F.size(lengths) > 1, 0.20)
    entry = entry - F.when(titles >= 0.8, 0.35).when(titles >= 0.5, 0.20).otherwise(0.0)
    entry = entry - _flag(_c("default_entry_title_count", 0) > 0, 0.25)
    entry = entry - F.when(links >= 0.8, 0.25).when(links >= 0.5, 0.15).otherwise(0.0)
    language = (_c("lang_feed", "") != "") | (_c("lang_http", "") != "") | _some("all_languages")
    feed = _flag(_c("title", "") != "", 0.30) + _flag(_c("link", "") != "", 0.30) + _flag(language, 0.20) + _flag(F.col("updated_date").isNotNull(), 0.20)
    own = {
        "recency": F.pow(F.lit(2.0), -age(now) / dates.HALF_LIFE),
        "content_richness": 0.50 * presence + 0.30 * length + 0.20 * profile,
        "entry_count": F.least(_c("entries_count", 0) / 20.0, F.lit(1.0)),
        "entry_metadata": F.least(F.greatest(entry, F.lit(0.0)), F.lit(1.0)),
        "feed_metadata": feed,
    }
    return {name: F.when(active(now), c).otherwise(0.0) for name, c in own.items()}


def cap() -> Column:
    """The most that repeated or stock titles, and repeated links, leave."""
    titles, links = _c("repeated_entry_title_ratio", 0.0), _c("repeated_entry_link_ratio", 0.0)
    stock = F.coalesce(F.try_divide(_c("default_entry_title_count", 0), F.col("entry_title_count")), F.lit(0.0))
    poor = (titles >= 0.8) | (stock >= 0.5)
    by_title = F.when(poor, 0.55).when((titles >= 0.5) | (stock > 0), 0.70).otherwise(1.0)
    by_link = F.when(links >= 0.8, 0.65).when(links >= 0.5, 0.80).otherwise(1.0)
    return F.least(by_title, by_link, F.when(poor & (links >= 0.8), 0.45).otherwise(1.0))


def scored(feeds: DataFrame, now: Column) -> DataFrame:
    """feeds with active, age_days, the sub-scores as a struct `components`, and score (four decimals)."""
    parts = components(now)
    out = feeds.withColumns({"active": active(now), "age_days": age(now), "components": F.struct(*(c.alias(n) for n, c in parts.items()))})
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.col(f"components.{name}")
    score = F.round(F.least(F.greatest(F.least(total, cap()), F.lit(0.0)), F.lit(1.0)), 4)
    return out.withColumn("score", F.when(F.col("active"), score).otherwise(0.0))


def high() -> Column:
    return F.col("score") > HIGH_QUALITY


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def by_format(scores: DataFrame) -> DataFrame:
    """Per format: feeds, above 0.5, mean, and how many are high, middling and low."""
    out = scores.groupBy(_c("format", "unknown").alias("format")).agg(
        F.count(F.lit(1)).alias("feeds"),
        count_if(high()).alias("quality"),
        F.round(F.avg("score"), 6).alias("mean"),
        count_if(F.col("score") >= HIGH).alias("high"),
        count_if((F.col("score") >= MIDDLE) & (F.col("score") < HIGH)).alias("middle"),
        count_if(F.col("score") < MIDDLE).alias("low"),
    )
    return out.orderBy(F.desc("mean"), "format")


def histogram(scores: DataFrame) -> DataFrame:
    """Ten bins of the score, those without feeds too; 1.0 is in the last."""
    bins = scores.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    found = scores.groupBy(F.least(F.floor(F.col("score") * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # ten rows at most


def summary(scores: DataFrame) -> DataFrame:
    """One row: counts and means over all feeds, the active ones, and those that are undated or stale."""
    own = F.col("active")
    dated = F.col("age_days").isNotNull()
    means = [F.round(F.avg(F.when(own, F.col(f"components.{n}"))), 6).alias(f"mean_{n}") for n in WEIGHTS]
    return scores.agg(
        F.count(F.lit(1)).alias("feeds"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean"),
        count_if(high()).alias("quality"),
        count_if(own).alias("active"),
        F.round(F.coalesce(F.avg(F.when(own, F.col("score"))), F.lit(0.0)), 6).alias("active_mean"),
        count_if(own & (_c("entries_count", 0) > 0)).alias("active_with_entries"),
        count_if(~dated).alias("undated"),
        count_if(dated & ~own).alias("stale"),
        *means,
    )


def split(scores: DataFrame, discovered: DataFrame) -> DataFrame:
    """Feeds, mean and high-quality count for feeds that pages announce, and for the others."""
    known = discovered.select(F.col("feed_url").alias("url")).distinct()
    parts = [scores.join(known, "url", how).withColumn("discovered", F.lit(how == "left_semi")) for how in ("left_semi", "left_anti")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("discovered").agg(F.count(F.lit(1)).alias("feeds"), F.round(F.avg("score"), 6).alias("mean"), count_if(high()).alias("quality"))
