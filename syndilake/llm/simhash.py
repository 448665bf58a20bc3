"""SimHash near-duplicates: BK-trees over the fingerprints of a shard, searched within a radius.

Fingerprints are dealt to shards by blocks of bits such that any two within the radius share a shard: of k blocks
the radius r can touch r, so k - r agree. Each shard's BK-tree lives in the one task that its members are dealt to;
a Spark broadcast would gather fingerprints on the driver. A query follows only the edges within the radius, and a
link is passed on only if it joins two groups that the shard has not joined yet, so that a group of n leaves n - 1
links, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import cut, mapped, small, table
from .components import components, named_components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Shards with more members than this are dealt again by the bits that they don't agree on.
SHARD = 2_048
DEALS = 2
#: Members of a shard, on average, up to which the number of blocks suffices.
MEAN = 128


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        block = hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row: fp is the fingerprint as a signed 64-bit integer, 0 for null and empty texts."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = ids.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [fingerprint(x.as_py() or "", shingle) for x in batch.column(1)]
            yield {"doc_id": batch.column(0), "fp": np.array(found, np.uint64).view(np.int64)}

    return mapped(ids, rows, f"doc_id {kind.simpleString()}, fp long", pa.schema([("doc_id", to_arrow_type(kind)), ("fp", pa.int64())]))


def blocks(n: int, radius: int = RADIUS) -> int:
    """Blocks to cut fingerprints into: the fewest for which random ones share shards of MEAN members at most."""
    k = radius + 1
    while k < radius + 5 and n > MEAN << (BITS * (k - radius) // k):
        k += 1
    return k


def edges_of(k: int) -> list[int]:
    return [BITS * i // k for i in range(k + 1)]


class Tree:
    """A BK-tree: a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, point: int, radius: int) -> list[int]:
        """Places of the points within the radius; then the point is added."""
        points, children = self.points, self.children
        if not points:
            points.append(point)
            children.append({})
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (points[at] ^ point).bit_count()
            if d <= radius:
                found.append(at)
            stack += [c for e, c in children[at].items() if -radius <= e - d <= radius]
        at = 0
        while True:
            d = (points[at] ^ point).bit_count()
            if d not in children[at]:
                children[at][d] = len(points)
                break
            at = children[at][d]
        points.append(point)
        children.append({})
        return found


def joined(points: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Pairs of places in points within the radius that connect all that are within it of each other, directly or not."""
    parent = list(range(len(points)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = Tree()
    for place, point in enumerate(points):
        for at in tree.add(point, radius):
            x, y = root(at), root(place)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield at, place


def dealt_again(hot: DataFrame, radius: int) -> DataFrame:
    """Rows (key, free, fp) of crowded shards, each dealt to radius + 1 smaller ones.

    free has the bits that the members of a shard may differ in. They are cut into radius + 1 blocks; two members within
    the radius agree on one of these at least, and meet in the shard of that block and its bits.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            key, free, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for mask in np.unique(free).tolist():
                own = np.flatnonzero(free == mask)
                bits = [x for x in range(BITS) if mask >> x & 1]
                cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    block = sum(1 << x for x in bits[a:b])
                    agreed = fp[own] & np.uint64(block)
                    yield {"old": key[own].view(np.int64), "block": [j] * len(own), "agreed": agreed.view(np.int64), "free": np.full(len(own), mask & ~block, np.uint64).view(np.int64), "fp": fp[own].view(np.int64)}

    types = pa.schema([("old", pa.int64()), ("block", pa.int32()), ("agreed", pa.int64()), ("free", pa.int64()), ("fp", pa.int64())])
    out = mapped(hot.select("key", "free", "fp"), rows, "old long, block int, agreed long, free long, fp long", types)
    return out.select(F.xxhash64("old", "block", "agreed").alias("key"), "free", "fp")


def shards(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): distinct fingerprints fp dealt to shards such that any two within the radius share one.

    Shards above SHARD members, which are rare unless a near-copy group is large, are dealt again, DEALS times at most,
    by the bits that their members may differ in. What is crowded still is cut into parts of half of SHARD, and every two
    parts are a shard.
    """
    k = blocks(n, radius)
    at = edges_of(k)
    masks = [((1 << at[i + 1]) - 1) ^ ((1 << at[i]) - 1) for i in range(k)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = []
    for c, chosen in enumerate(combinations(range(k), k - radius)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.struct(F.xxhash64(F.lit(c), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long"))).alias("key"), F.lit(signed(mask ^ ((1 << BITS) - 1))).cast("long").alias("free")))
    open_ = points.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.free", "fp")
    done = []
    for deal in range(DEALS + 1):
        hot = cut(open_.groupBy("key").count().filter(F.col("count") > SHARD).select("key", F.ceil(F.col("count") / max(1, SHARD // 2)).alias("parts")))
        if not hot.limit(1).count():
            break
        told = open_.join(small(hot), "key", "left")
        done.append(told.filter("parts IS NULL").select("key", "fp"))
        open_ = told.filter("parts IS NOT NULL")
        if deal < DEALS:
            open_ = cut(dealt_again(open_, radius))
            continue
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least("part", j), F.greatest("part", j)))
        open_ = open_.withColumn("part", part).select(F.explode(pairs).alias("key"), "fp")
    for rows in done:
        open_ = open_.select("key", "fp").unionByName(rows)
    return open_.select("key", "fp")


def links(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all pairs within the radius. No points give no edges."""
    dealt = shards(points, n, radius).repartition("key").sortWithinPartitions("key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, points, out = None, [], ([], [])

        def close() -> None:
            for x, y in joined([p & 0xFFFFFFFFFFFFFFFF for p in points], radius) if len(points) > 1 else ():
                out[0].append(points[x])
                out[1].append(points[y])

        for batch in batches:
            for shard, point in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != key:
                    close()
                    key, points = shard, []
                points.append(point)
            if len(out[0]) > 10_000:
                yield {"a": out[0], "b": out[1]}
                out = ([], [])
        close()
        yield {"a": out[0], "b": out[1]}

    return mapped(dealt, rows, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Repeated ids and rows give a row each. Rows
    with null ids link like any other; a component of such rows alone is null. An empty table gives no rows. Other
    columns are ignored, whatever their names. Ids may be of any type that can be ordered.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, distinct.count(), radius))
    named = named_components(distinct.withColumnRenamed("fp", "node"), found).withColumnRenamed("node", "fp")
    out = each.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
