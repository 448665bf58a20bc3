"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations alone.

Sources, then groups of shards, then shards of documents get equal-token blocks by highest quotients. A shard's
documents lie on a tape in an order that depends on the seed and the document alone; the shard's blocks are the
first ones on that tape, which is passed over at most `repeat` times. Documents are dealt to shards by id and text; rows
that are alike in both are one entry of the tape until the end. Sources are labels: their plan is made in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROW_BYTES, WORD, cut, small, table

WEIGHTS, SHARE, REPEAT, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Words of a shard, on average; a window sorts the documents of one shard.
SHARD_WORDS = 262_144
#: Rows that are alike which one task writes; more are dealt out.
RUN = 4_096
#: A block has as many words as one part in RESOLUTION of the mix, MAX_BLOCK at most and 1 at least.
RESOLUTION, MAX_BLOCK = 1 << 20, 256


def apportion(rows: DataFrame, parents: list[str], child: str, weight: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each row when its parents' `seats` go to the highest quotients weight / (2k + 1).

    With a common divisor the quotas q = weight / sum * seats round to seats that are off by at most
    share * n / 2 + 1/2, n being the number of children. So only quotients that near to the quota compete; the ones
    below are all won. That is n + O(n) rows instead of one for each seat. Ties go to the first child.
    """
    w = Window.partitionBy(*parents)
    share = F.when(F.sum(weight).over(w) > 0, F.col(weight) / F.sum(weight).over(w)).otherwise(0.0)
    near = rows.withColumns({"_share": share, "_n": F.count(F.lit(1)).over(w)})
    near = near.withColumn("_m", F.floor(F.col("_share") * F.col("_n") / 2).cast("long") + 2)
    near = near.withColumn("_base", F.greatest(F.lit(0), F.floor(F.col("_share") * F.col(seats)).cast("long") - F.col("_m")))
    near = near.withColumn("_rest", F.col(seats) - F.sum("_base").over(w))
    near = near.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_m") + 1)))
    near = near.withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    order = Window.partitionBy(*parents).orderBy(F.desc("_q"), child, "_k")
    won = (F.row_number().over(order) <= F.col("_rest")) & (F.col("_q") > 0)
    near = near.withColumn("_won", won.cast("long"))
    return near.groupBy(*rows.columns).agg((F.first("_base") + F.sum("_won")).alias(out))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """Adds place (from 0, by code point, null last) and target to rows of (source, source_size).

    Filling up by weight to caps: in order of cap / weight a source is capped as long as its part of what is left
    would be above its cap; the others share what the capped ones leave.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    rows = totals.withColumn("place", place)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumns({"_cap": F.col("source_size") * float(repeat), "_mix": F.sum("source_size").over(Window.partitionBy()) * share})
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_mix") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_full", left * F.col("weight") >= F.col("_cap") * weight)
    every = Window.partitionBy()
    capped = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_mix") - capped) * F.col("weight") / free)
    return rows.withColumn("target", target).drop("_full", "_cap", "weight")


def _hex(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: str = SEED, shard_words: int = SHARD_WORDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, whole, and the columns `carried`.

    taken: the words that the mix takes of the document, `repeat` times its size at most; `whole`: taken in whole
    copies, rounded. Null texts have size 0; a null source is a source; a null id is an id like any other. Repeated
    rows count each; of rows that are alike some are taken and others not. An empty table gives no rows; sources without words get target 0 and none is taken. Other columns
    are ignored, whatever their names.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), *carried)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_text")))
    sized = sized.withColumn("key", key).drop("_text")
    sized = cut(sized.groupBy("doc_id", "source", "size", "key", *carried).agg(F.count(F.lit(1)).alias("rows")))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    plan = targets(totals, weights, share, repeat)
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("_mix") / RESOLUTION))).cast("long")
    plan = plan.withColumn("block", block).withColumn("_blocks", F.round(F.col("_mix") / F.col("block")).cast("long"))
    plan = apportion(plan, [], "place", "target", "_blocks", "source_blocks").drop("_blocks", "_mix")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    plan = plan.withColumn("_shards", shards).withColumn("groups", F.ceil(F.sqrt("_shards")).cast("long"))
    plan = cut(plan.withColumn("per_group", F.ceil(F.col("_shards") / F.col("groups")).cast("long")).drop("_shards"))
    wide = plan.agg(F.max(F.octet_length("source"))).first()[0] or 0
    few = small(plan) if wide <= BROADCAST_ROW_BYTES else plan

    placed = sized.join(few.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    placed = placed.withColumns({"part": F.pmod(_hex(F.col("key"), 1), F.col("groups")), "shard": F.pmod(_hex(F.col("key"), 9), F.col("per_group"))})
    fine = ["place", "part", "shard"]
    by_shard = placed.groupBy(*fine, "block", "source_blocks").agg(F.sum(F.col("size") * F.col("rows")).alias("shard_size"))
    by_part = by_shard.groupBy("place", "part", "source_blocks").agg(F.sum("shard_size").alias("part_size"))
    by_part = apportion(by_part, ["place"], "part", "part_size", "source_blocks", "part_blocks").drop("part_size", "source_blocks")
    by_shard = apportion(by_shard.join(by_part, ["place", "part"]), ["place", "part"], "shard", "shard_size", "part_blocks", "shard_blocks")
    words = F.least(F.col("shard_blocks") * F.col("block"), F.col("shard_size") * repeat)
    quotas = by_shard.select(*fine, "shard_size", words.alias("shard_words"))

    tape = Window.partitionBy(*fine).orderBy(F.substring("key", 17, 16), "doc_id", "size", *carried)
    own = F.col("size") * F.col("rows")
    at = F.sum(own).over(tape.rowsBetween(Window.unboundedPreceding, 0)) - own
    laid = placed.withColumn("at", at).join(quotas, fine)
    many = sized.agg(F.max("rows")).first()[0] or 0
    if many > RUN:
        laid = laid.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN).cast("long")))).repartition("key", "run")
        first = F.col("run") * RUN
    else:
        first = F.lit(0).cast("long")
    laid = laid.withColumn("nth", F.explode(F.sequence(first, F.least(first + RUN, F.col("rows")) - 1)))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("shard_words") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("shard_words") - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at") - F.col("nth") * F.col("size")))
    laid = laid.withColumn("taken", taken)
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return laid.select("doc_id", "size", "source_size", "target", "taken", whole.alias("whole"), *carried)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("whole")


def _seats(name: str, rows: str, parents: str, child: str, weight: str, seats: str, out: str) -> str:
    """SQL for highest quotients, one row for each seat that a child could win."""
    by = f"PARTITION BY {parents}" if parents else ""
    using = f"{parents}, {child}" if parents else child
    return f"""
{name}_q AS (SELECT *, {weight} / (2 * k + 1) AS q FROM {rows}, LATERAL (SELECT unnest(range(0, {seats} + 1)) AS k) t),
{name}_r AS (SELECT *, row_number() OVER ({by} ORDER BY q DESC, {child}, k) AS rn FROM {name}_q),
{name} AS (SELECT a.*, w.n AS {out} FROM {rows} a
  JOIN (SELECT {using}, count(*) FILTER (rn <= {seats} AND q > 0) AS n FROM {name}_r GROUP BY {using}) w USING ({using}))"""


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
keyed AS (SELECT *, count(*) AS rows_ FROM sized GROUP BY ALL),
totals AS (SELECT source, sum(size * rows_)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM keyed GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap,
  (SELECT sum(source_size) FROM totals)::DOUBLE * 1.5::DOUBLE AS mix FROM totals),
ordered AS (SELECT *, mix - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM weighed),
filled AS (SELECT *, left_words * weight >= cap * left_weight AS capped FROM ordered),
aimed AS (SELECT source, place, source_size, CASE WHEN capped THEN cap ELSE
    (mix - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target,
  greatest(1, least({MAX_BLOCK}, floor(mix / {RESOLUTION})))::BIGINT AS block, mix FROM filled),
counted AS (SELECT *, round(mix / block)::BIGINT AS blocks FROM aimed),
whole_q AS (SELECT *, target * blocks / mix AS quota, (SELECT count(*) FROM counted) AS n FROM counted),
cand AS (SELECT place, target, blocks, greatest(0, floor(quota) - n)::BIGINT AS base, unnest(range(greatest(0, floor(quota) - n)::BIGINT, (floor(quota) + n + 2)::BIGINT)) AS k FROM whole_q WHERE target > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS rn FROM cand),
bases AS (SELECT sum(base) AS b FROM (SELECT DISTINCT place, base FROM cand)),
won AS (SELECT place, max(base) + count(*) FILTER (rn <= blocks - (SELECT b FROM bases)) AS source_blocks FROM ranked GROUP BY place),
planned AS (SELECT c.*, coalesce(source_blocks, 0)::BIGINT AS source_blocks, greatest(1, ceil(source_size / {SHARD_WORDS}.0))::BIGINT AS shards FROM counted c LEFT JOIN won USING (place)),
grouped AS (SELECT *, ceil(sqrt(shards))::BIGINT AS groups FROM planned),
placed AS (SELECT k.*, g.* EXCLUDE (source), ('0x' || substr(key, 1, 8))::BIGINT % groups AS part,
  ('0x' || substr(key, 9, 8))::BIGINT % ceil(shards / groups)::BIGINT AS shard
  FROM keyed k JOIN grouped g ON k.source IS NOT DISTINCT FROM g.source),
shard0 AS (SELECT place, part, shard, block, source_blocks, sum(size * rows_)::BIGINT AS shard_size FROM placed GROUP BY ALL),
part0 AS (SELECT place, part, source_blocks, sum(shard_size)::BIGINT AS part_size FROM shard0 GROUP BY ALL),
{_seats("part1", "part0", "place", "part", "part_size", "source_blocks", "part_blocks")},
shard1 AS (SELECT s.*, p.part_blocks FROM shard0 s JOIN part1 p USING (place, part)),
{_seats("shard2", "shard1", "place, part", "shard", "shard_size", "part_blocks", "shard_blocks")},
quotas AS (SELECT place, part, shard, shard_size, least(shard_blocks * block, shard_size * 2)::BIGINT AS shard_words FROM shard2),
laid AS (SELECT p.*, q.shard_size, q.shard_words, sum(size * rows_) OVER (PARTITION BY place, part, shard ORDER BY substr(key, 17, 16), doc_id, size ROWS UNBOUNDED PRECEDING) - size * rows_ AS at_word
  FROM placed p JOIN quotas q USING (place, part, shard)),
each AS (SELECT *, unnest(range(rows_)) AS nth FROM laid),
passed AS (SELECT *, CASE WHEN shard_size > 0 THEN shard_words // shard_size ELSE 0 END AS passes FROM each)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, shard_words - passes * shard_size - at_word - nth * size)))::BIGINT AS taken FROM passed
"""
