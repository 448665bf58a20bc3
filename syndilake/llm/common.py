"""What the corpus operators share: reading tables, cutting lineage and joining sides whose size is checked."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` for the regular expressions of the JVM.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many rows of at most this many bytes; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_ROW_BYTES = 10_000, 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cuts after which the driver collects garbage.
CUTS = 12
_cuts = count(1)
#: The size in bytes that Spark takes for a table it knows nothing of.
UNKNOWN = (1 << 63) - 1


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own. Shuffle files, broadcasts and plans of what was cut
    off go when the driver's JVM collects garbage; it's asked to now and then, so that loops don't pile them up.

    A checkpoint keeps the size that Spark has estimated for it, and that of a join is the product of its sides: in a loop the
    number's digits double with each join, in plans that the driver holds. From UNKNOWN on it's forgotten.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="syndilake-"))
    if next(_cuts) % CUTS == 0:
        context._jvm.System.gc()
    return _sized(df.checkpoint())


def _sized(df: DataFrame) -> DataFrame:
    """A checkpoint whose estimated size is UNKNOWN at most; its rows, partitions and order are the same."""
    spark = df.sparkSession
    run = df._jdf.queryExecution()
    if int(run.optimizedPlan().stats().sizeInBytes()) <= UNKNOWN:
        return df
    jvm, plan, session = spark._jvm, run.logical(), spark._jsparkSession
    nothing, known = getattr(getattr(jvm.scala, "None$"), "MODULE$"), jvm.scala.Option.apply(plan.constraints())
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, nothing, known)
    return DataFrame(getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(session, plan), spark)


def scratch(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, for written tables."""
    cut(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if a count proves that it's small; df must have rows of bounded width and a cut lineage."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def freed(spark: SparkSession, job: Callable[[], None]) -> None:
    """Runs a job whose shuffle files go as soon as it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        job()
    finally:
        spark.conf.set(key, before)


def texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A column of texts, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=types)

    return df.mapInArrow(run, schema)
