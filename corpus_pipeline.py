"""A corpus pipeline: toxic documents go, one document of each group of near-duplicates stays, personal data is masked,
sources are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syndilake.llm import bpe, mixing, pii, resemblance, toxicity
from syndilake.llm.common import cut, dropped, scratch, table
from syndilake.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts as toxic go; it learns from the labels of the table itself.

    Every row is judged for itself: repeated rows and ids go or stay together if their texts are alike, null and empty
    texts are no terms, null ids have no label. An empty table gives no rows. Only the columns of documents stay.
    """
    ship(spark)
    rated = toxicity.score(docs.select(*COLUMNS), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rated.filter(F.col("predicted") == 0).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates its smallest doc_id stays; rows without a doc_id stay.

    Near-duplicates have 0.8 or more of their five-word shingles in common, by exact comparison (Jaccard), or are linked by
    such. Different texts with one doc_id are different documents; of rows that are alike in both, the first by the other
    columns stays. Null and empty texts are copies of each other. An empty table gives no rows.
    """
    ship(spark)
    found = resemblance.near_duplicates(docs).filter(F.col("first") & F.col("doc_id").isNotNull())
    kept = cut(found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_taken")).agg(F.count(F.lit(1)).alias("_rows")))
    own = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text"))
    met = own.filter(F.col("doc_id").isNotNull()).join(kept, (F.col("_mark") == F.col("_taken")) & (F.col("doc_id") == F.col("_id")))
    out = met.filter("_rows = 1").select(*COLUMNS)
    if kept.filter("_rows > 1").limit(1).count():
        out = out.unionByName(met.filter("_rows > 1").groupBy("doc_id", "_mark").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*"))
    return out.unionByName(own.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and terms that reveal it generalised or removed; n_chars is that of the new text.

    Every row stays, also those that repeat or have no id; null texts stay null. An empty table gives no rows.
    """
    ship(spark)
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays in as many whole copies as the mix takes of it, rounded: 0, 1 or 2; so does a row without a doc_id.

    Rows that repeat are documents each; null sources are a source; texts without words aren't taken. An empty table gives
    no rows.
    """
    ship(spark)
    row = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    own = docs.select(*COLUMNS).withColumn("_row", row)
    mixed = mixing.mix(own, carried=("_row",)).groupBy("doc_id", "_row").agg(F.sum("whole").alias("whole"), F.count(F.lit(1)).alias("rows"))
    taken = cut(mixed.filter(F.col("whole") > 0).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_taken"), "whole", "rows"))
    met = own.join(taken, (F.col("_row") == F.col("_taken")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*COLUMNS, "whole", "rows")
    once = met.filter("rows = 1").select(*COLUMNS, "whole")
    if taken.filter("rows > 1").limit(1).count():  # of rows that are alike one stands for all
        once = once.unionByName(met.filter("rows > 1").dropDuplicates().select(*COLUMNS, "whole"))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy; null texts count as empty, an empty table gives no rows."""
    ship(spark)
    return bpe.digests(docs, *bpe.default())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("byte-level bpe", encode),
]
#: Trained models and hashes in Python aren't in reach of SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written as Parquet in the shared folder and read again.

    A result is deleted once the next one is written; the last one stays, as the rows that are returned.
    """
    docs = table(spark, sf_dir, "documents")
    to = f"{scratch(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
        if k:
            dropped(spark, f"{to}/{k - 1}")
    return docs
