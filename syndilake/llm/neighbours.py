"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors of length one are cut into halves, and each half gets its own centroids; a vector lies in the cell of its
pair of centroids. A query walks over pairs by the sum of the two squared distances, with a heap, until the cells that
it has seen hold a part of the index; the entries of those cells are ranked exactly. How large a part is measured on the
sample that the centroids are fitted to: as much as ASKED of its vectors need to see RECALL of their true neighbours. Cells with the same first
centroid are stored together, in blocks of BLOCK entries, so that a large cell is spread over tasks. A query is sent
once to each block with a cell that it has seen.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, mapped, table

#: Vectors that the centroids are fitted to, the first by hash of their id; entries of a cell on average, and most
#: centroids of each half; cells that hold more than 1 / EVEN of the index count as that much of it; entries of a block;
#: neighbours of a query.
SAMPLE, CELL, CENTROIDS, EVEN, BLOCK, TOP = 20_000, 32, 128, 64, 4_096, 5
#: Vectors of the sample whose neighbours are looked for, and the part of them that is to be seen.
ASKED, RECALL = 400, 0.96


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def centroids(points: np.ndarray, k: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k of the points; a centroid without points stays."""
    rng = np.random.default_rng(seed)
    found = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(points, found).argmin(1)
        for c in np.unique(own):
            found[c] = points[own == c].mean(0)
    return found


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ to.T + (to**2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Pairs of places by first + second, until `held` of them come to enough."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], 0.0, []
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        pair = int(a[i]), int(b[j])
        seen += held[pair]
        if held[pair]:
            out.append(pair)
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return out


def needed(points: np.ndarray, first: np.ndarray, second: np.ndarray, half: int, counted: np.ndarray, top: int, recall: float = RECALL) -> float:
    """The part of the index that the first ASKED points must see to find that part of their neighbours among the points."""
    queries = points[:ASKED]
    if len(points) < 2:
        return 1.0
    a, b = distances(points[:, :half], first).argmin(1), distances(points[:, half:], second).argmin(1)
    scores = queries @ points.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(top, len(points) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    sums = distances(queries[:, :half], first)[:, :, None] + distances(queries[:, half:], second)[:, None, :]
    parts = []
    for q, cells in enumerate(sums.reshape(len(queries), -1)):
        order = np.argsort(cells, kind="stable")
        seen = np.empty(len(order))
        seen[order] = np.cumsum(counted.ravel()[order])
        parts.append(seen[a[near[q]] * len(second) + b[near[q]]])
    return float(np.quantile(np.concatenate(parts), recall) / counted.sum())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products, each by the same sequence of operations, so that equal vectors tie exactly."""
    return np.einsum("ik,jk->ij", a, b)


def best(queries: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, open_: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(place of the query, place of the entry, cosine) of the k nearest open entries."""
    norms = np.sqrt(np.einsum("ik,ik->i", queries, queries))[:, None] * np.sqrt(np.einsum("ik,ik->i", entries, entries))
    scores = np.where(open_, dots(queries, entries) / norms, -np.inf)
    for q, row in enumerate(scores):
        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= least) & (row > -np.inf))
        for e in near[np.lexsort((entry_ids[near], -row[near]))][:k]:
            yield q, int(e), float(row[e])


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, seen: float | None = None, n_centroids: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query row's nearest entries; seen=1 gives the exact ones.

    seen: the part of the index that a query sees; by default what needed() measures.

    A query is taken for one row of the index, the one with its id and vector, which is not its neighbour; a second row
    like it is. Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id or with another length than most vectors of the index. Query rows that repeat have
    their neighbours each. An empty index or no queries give no rows. Other columns are ignored, whatever their names.
    n_centroids of each half: by default as many as make cells of CELL entries, CENTROIDS at most. Ids may be any type
    that can be ordered.
    """
    packed = [F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")]
    entries = index.select(*packed).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    asked = queries.select(*packed).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    kind = entries.schema["vec_id"].dataType
    size = F.size("vector")
    common = entries.groupBy(size.alias("width")).count().orderBy(F.desc("count"), "width").first()
    spark = index.sparkSession
    if common is None:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, vec_id {kind.simpleString()}, score double")
    width, n = common["width"], common["count"]
    entries, asked = entries.filter(size == width), asked.filter(size == width)
    half = (width + 1) // 2
    k = n_centroids or max(1, min(CENTROIDS, round((n / CELL) ** 0.5)))
    fitted = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    points = np.stack(fitted.to_numpy()).astype(np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    first = centroids(points[:, :half], k)
    second = centroids(points[:, half:], k) if half < width else np.zeros((1, 0))
    # rows are told apart by id and vector; twins share a mark
    mark = F.xxhash64("vec_id", "vector")
    entries = entries.select("vec_id", mark.alias("mark"), "vector")
    asked = asked.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies")).select("vec_id", mark.alias("mark"), "copies", "vector")

    def unit_halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        return raw, distances(unit[:, :half], first), distances(unit[:, half:], second)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, to_first, to_second = unit_halves(batch.column(2))
            yield {"vec_id": batch.column(0), "mark": batch.column(1), "vector": [x.tobytes() for x in np.ascontiguousarray(raw)], "a": to_first.argmin(1).astype(np.int32), "b": to_second.argmin(1).astype(np.int32)}

    own = to_arrow_type(kind)
    types = pa.schema([("vec_id", own), ("mark", pa.int64()), ("vector", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])
    cells = cut(mapped(entries, placed, f"vec_id {kind.simpleString()}, mark long, vector binary, a int, b int", types))
    held = np.zeros((len(first), len(second)))
    for r in cells.groupBy("a", "b").count().collect():  # CENTROIDS squared at most
        held[r.a, r.b] = r["count"]
    blocks = np.maximum(1, -(-held.sum(1) // BLOCK)).astype(int).tolist()
    counted = np.minimum(held, n // EVEN + 1)
    if seen is None:
        seen = needed(points, first, second, half, counted, top)
    enough = counted.sum() * seen if seen < 1 else np.inf

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, to_first, to_second = unit_halves(batch.column(3))
            for q in range(batch.num_rows):
                opened: dict[int, np.ndarray] = {}
                for a, b in walk(to_first[q], to_second[q], counted, enough):
                    opened.setdefault(a, np.zeros(len(second), bool))[b] = True
                rows = [(a, block, np.packbits(mask).tobytes()) for a, mask in opened.items() for block in range(blocks[a])]
                same = lambda x: [x] * len(rows)  # noqa: E731, B023
                yield {"a": [r[0] for r in rows], "block": [r[1] for r in rows], "kind": same(1), "vec_id": pa.array(same(batch.column(0)[q].as_py()), own), "mark": same(batch.column(1)[q].as_py()), "copies": same(batch.column(2)[q].as_py()), "b": same(0), "cells": [r[2] for r in rows], "vector": same(raw[q].tobytes())}

    columns = f"a int, block int, kind int, vec_id {kind.simpleString()}, mark long, copies long, b int, cells binary, vector binary"
    types = pa.schema([("a", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("vec_id", own), ("mark", pa.int64()), ("copies", pa.int64()), ("b", pa.int32()), ("cells", pa.binary()), ("vector", pa.binary())])
    shares = F.element_at(F.array(*map(F.lit, blocks)), F.col("a") + 1)
    dealt = cells.select("a", F.pmod(F.xxhash64("vec_id"), shares).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "mark", F.lit(0).cast("long").alias("copies"), "b", F.lit(None).cast("binary").alias("cells"), "vector")
    both = dealt.unionByName(mapped(asked, sent, columns, types)).repartition("a", "block").sortWithinPartitions("a", "block", "kind")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, parts = None, []
        entries = ids = marks = cell = order = None

        def gathered() -> None:
            nonlocal entries, ids, marks, cell, order, parts
            if parts:
                entries = np.concatenate([p[0] for p in parts])
                ids, marks, cell = pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
                places = pa.compute.sort_indices(ids).to_numpy()
                order = np.empty(len(places), np.int64)
                order[places] = np.arange(len(places))
                parts = []

        for batch in batches:
            if not batch.num_rows:
                continue
            a, block, sort = (batch.column(i).to_numpy() for i in range(3))
            vectors = matrix(batch.column(8), width)
            changes = np.flatnonzero((np.diff(a) != 0) | (np.diff(block) != 0) | (np.diff(sort) != 0)) + 1
            for x, y in zip([0, *changes.tolist()], [*changes.tolist(), len(a)]):
                if (a[x], block[x]) != key:
                    key, parts, entries = (a[x], block[x]), [], None
                if sort[x] == 0:
                    parts.append((vectors[x:y], batch.column(3).slice(x, y - x), batch.column(4).slice(x, y - x).to_numpy(), batch.column(6).slice(x, y - x).to_numpy()))
                    continue
                gathered()
                for s in range(x, y, 256) if entries is not None else ():
                    e = min(y, s + 256)
                    masks = np.unpackbits(np.frombuffer(b"".join(batch.column(7).slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1), axis=1)
                    found = list(best(vectors[s:e], entries, order, masks[:, cell] > 0, top + 1))
                    q, at = [s + i for i, _, _ in found], [i for _, i, _ in found]
                    asker, its = batch.column(3).take(pa.array(q, pa.int64())), ids.take(pa.array(at, pa.int64()))
                    mine = batch.column(4).to_numpy()[q] == marks[at] if q else np.zeros(0, bool)
                    yield {"query_id": asker, "mark": batch.column(4).take(pa.array(q, pa.int64())), "copies": batch.column(5).take(pa.array(q, pa.int64())), "vec_id": its, "twin": mine, "score": [v for *_, v in found]}

    types = pa.schema([("query_id", own), ("mark", pa.int64()), ("copies", pa.int64()), ("vec_id", own), ("twin", pa.bool_()), ("score", pa.float64())])
    found = mapped(both, ranked, f"query_id {kind.simpleString()}, mark long, copies long, vec_id {kind.simpleString()}, twin boolean, score double", types)
    each = Window.partitionBy("query_id", "mark")
    order = each.orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top + 1)
    # one of the rows like the query is the query itself; without one among the nearest, the last of them is one too many
    itself = F.min(F.when(F.col("twin"), F.col("place"))).over(each)
    found = found.withColumn("itself", F.coalesce(itself, F.lit(top + 1))).filter(F.col("place") != F.col("itself"))
    rank = (F.col("place") - (F.col("place") > F.col("itself")).cast("int")).cast("int")
    found = found.select("query_id", rank.alias("rank"), "vec_id", "score", "copies")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
