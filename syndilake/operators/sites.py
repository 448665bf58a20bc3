"""Registrable sites by a whole public suffix list, as a table that hosts are looked up in.

The list is a small table (some ten thousand rules): it's broadcast once its rows are counted, and a host is looked up once
for each number of labels that rules have. A longer table is joined by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import SUFFIXES, bare_host, is_address, site

#: Rules that are broadcast at most, and labels of a rule that are looked up at most.
RULES, LABELS = 100_000, 8


def _table(lines: DataFrame) -> DataFrame:
    """suffix, labels, plain, wild, exempt of rules (value): what `*.` and `!` stand before, and which of them do."""
    rule = F.lower(F.regexp_extract("value", r"^\s*([^\s/]\S*)", 1))
    own = lines.select(rule.alias("rule")).filter(F.col("rule") != "")
    kind = F.when(F.col("rule").startswith("*."), "wild").when(F.col("rule").startswith("!"), "exempt").otherwise("plain")
    own = own.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind"))
    flags = [F.max(F.col("kind") == k).alias(k) for k in ("plain", "wild", "exempt")]
    return own.groupBy("suffix").agg(*flags).withColumn("labels", F.size(F.split("suffix", r"\.")))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public suffix list: a text file with a rule a line; what follows a space, and lines from // on, don't count."""
    return _table(spark.read.text(path))


def suffix_table(spark: SparkSession, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    return _table(spark.createDataFrame([(s,) for s in suffixes], "value string"))


def with_site(rows: DataFrame, url: Column, suffixes: DataFrame | None = None, name: str = "site") -> DataFrame:
    """rows with the registrable site of a URL, as functions.url.site() has it, by a table of suffixes if one is given."""
    if suffixes is None:
        return rows.withColumn(name, site(url))
    known = suffixes.groupBy("labels").count().collect()  # LABELS rows at most count
    depths = sorted(r["labels"] for r in known if r["labels"] <= LABELS)
    small = sum(r["count"] for r in known) <= RULES
    host, labels = F.col("_host"), F.split("_host", r"\.")
    out = rows.withColumn("_host", bare_host(url))
    for d in depths:
        rules = suffixes.filter(F.col("labels") == d).select(F.col("suffix").alias(f"_suffix{d}"), *(F.col(k).alias(f"_{k}{d}") for k in ("plain", "wild", "exempt")))
        tail = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - d + 1), d), ".")
        found = F.when(F.size(labels) >= d, tail) == F.col(f"_suffix{d}")
        out = out.join(F.broadcast(rules) if small else rules, found, "left")
    n = F.size(labels)
    lengths = [F.when(F.col(f"_plain{d}"), d) for d in depths] + [F.when(F.col(f"_wild{d}") & (n > d), d + 1) for d in depths]
    exempt = [F.when(F.col(f"_exempt{d}"), d - 1) for d in depths]
    longest = F.greatest(F.lit(1), F.lit(1), *(F.coalesce(x, F.lit(1)) for x in lengths))
    if exempt:
        longest = F.coalesce(F.greatest(F.lit(None).cast("int"), F.lit(None).cast("int"), *exempt), longest)
    own = F.array_join(F.slice(labels, F.greatest(F.lit(1), n - longest), longest + 1), ".")
    found = F.when(is_address(host), host).when(n <= longest, host).otherwise(own)
    return out.withColumn(name, found).drop("_host", *(f"_{k}{d}" for d in depths for k in ("suffix", "plain", "wild", "exempt")))
