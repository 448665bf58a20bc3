"""Ages, recency and cadence as column expressions. `now` is always given: nothing asks the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, RECENT = 86_400, 7 * 86_400
#: Days: half-life of recency, oldest that still counts, and how far ahead a date may be.
HALF_LIFE, CUTOFF, AHEAD = 120.0, 365.0, 1.0
CADENCES = ((1, "sub-daily"), (2, "daily"), (8, "weekly"), (32, "monthly"))


def seconds_before(now: Column, date: Column) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(date)


def age_days(date: Column, now: Column) -> Column:
    """Days; none for a date that's more than AHEAD days ahead, 0 for one that's less."""
    age = seconds_before(now, date) / float(DAY)
    return F.when(age >= -AHEAD, F.greatest(F.lit(0.0), age))


def recency_age(newest: Column, updated: Column, now: Column) -> Column:
    """Age of the newest entry, else of the feed's own date."""
    return F.coalesce(age_days(newest, now), age_days(updated, now))


def recently(date: Column, at: Column) -> Column:
    """In the seven days before a time."""
    return F.coalesce(seconds_before(at, date).between(0, RECENT - 1), F.lit(False))


def request_time(text: Column, otherwise: Column) -> Column:
    """An ISO date as crawlers write it, else any other that Spark reads; `otherwise` for anything else. operators.feeds tries free forms too."""
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), text), F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(text), otherwise)


def cadence_days(newest: Column, oldest: Column, entries: Column) -> Column:
    """Days between entries, over all of them, dated or not; none for fewer than two or without a span."""
    span = F.unix_seconds(newest) - F.unix_seconds(oldest)
    return F.when((entries > 1) & (span > 0), span / float(DAY) / (entries - 1))


def cadence_bucket(days: Column) -> Column:
    out = F.when(days.isNull(), "unknown")
    for most, name in CADENCES:
        out = out.when(days < most, name)
    return out.otherwise("slower")
