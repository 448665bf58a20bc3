"""Distinct sites: exact, by Spark's own sketch, and by HyperLogLog over CRC-32 with 4,096 registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12


def exact(rows: DataFrame, column: str = "site") -> DataFrame:
    return rows.agg(F.countDistinct(column).alias("sites"))


def approximate(rows: DataFrame, column: str = "site", error: float = 0.02) -> DataFrame:
    return rows.agg(F.approx_count_distinct(column, error).alias("sites"))


def registers(rows: DataFrame, column: str = "site") -> DataFrame:
    """register, rho: the lowest bits of the checksum choose a register, the others' leading zeros are its rank."""
    own = rows.filter(F.coalesce(F.col(column), F.lit("")) != "").select(F.crc32(F.col(column).cast("binary")).alias("h"))
    rest = F.shiftright("h", BITS)
    width = 32 - BITS
    rho = F.when(rest == 0, width + 1).otherwise(width - F.length(F.bin(rest)) + 1)
    return own.groupBy(F.col("h").bitwiseAND((1 << BITS) - 1).cast("int").alias("register")).agg(F.max(rho).cast("int").alias("rho"))


def merged(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("register").agg(F.max("rho").alias("rho"))


def estimate(sketch: DataFrame) -> DataFrame:
    """One row with the estimate: linear counting while it's low."""
    m = 1 << BITS
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = sketch.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("s"))
    empty = m - F.col("k")
    raw = alpha * m * m / (F.col("s") + empty)
    low = F.log(m / empty.cast("double")) * m
    return sums.select(F.floor(F.when((raw <= 2.5 * m) & (empty > 0), low).otherwise(raw)).cast("long").alias("sites"))

