"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash and MinHash only say what to compare.

Texts with the same set of shingles are one node. Nodes that share a MinHash band, or a group of near SimHash
fingerprints (the BK-trees of `simhash`), are candidates. A candidate group is compared in one task, on the sets
themselves, and the links that connect its members are passed on. A group with more than GROUP shingles is cut into
parts: each part is compared in a task of its own, with the most linked nodes of all parts (pivots) as guests; then the
nodes that aren't in the group's largest component yet are guests of every part. A pair that is in the largest component
needs no comparison, and any other meets where one of the two is a guest. A pair of the least similarity shares none of
the bands with a probability of (1 - LEAST ** ROWS) ** BANDS, 1 in 12,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import cut, mapped, small
from .components import components, named_components
from .simhash import SEED, fingerprint, links

SHINGLE = 5
#: Least similarity of near-duplicates, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 7
#: Shingles of a candidate group that one task compares, and pivots of each part of a larger one.
GROUP, PIVOTS = 1 << 21, 2
#: Shingles that are permuted at a time.
BLOCK = 4_096
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the runs of `shingle` words, sorted; that of all words if there are no more, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A signed key for each band of ROWS least values under permutations; none for the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), BLOCK):
        x = own[k : k + BLOCK, None] * _TIMES + _PLUS
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    return [signed(xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> Iterator[tuple[int, int]]:
    """Pairs of places at least that similar that connect all that are, directly or not.

    A search from the sets with the commonest shingles on: what is reached is compared with what isn't yet, through an
    index of shingles that is built anew when half of it is reached. A star is done when its centre is.
    """
    sizes = np.array([len(x) for x in sets], np.int64)

    def index(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([sets[i] for i in places])
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(places, sizes[places])[order]

    values, owners = index(np.arange(len(sets)))
    first = np.searchsorted(values, values, "left")
    common = np.searchsorted(values, values, "right") - first
    central = np.bincount(owners, weights=common, minlength=len(sets)) / np.maximum(sizes, 1)
    alive = np.ones(len(sets), bool)
    left = indexed = len(sets)
    for seed in np.argsort(-central, kind="stable").tolist():
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        reached = [seed]
        while reached and left:
            at = reached.pop()
            lo, hi = np.searchsorted(values, sets[at], "left"), np.searchsorted(values, sets[at], "right")
            n = hi - lo
            who = owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found, shared = np.unique(who[alive[who]], return_counts=True)
            close = found[shared * least[1] >= (sizes[at] + sizes[found] - shared) * least[0]]
            alive[close] = False
            left -= len(close)
            reached += close.tolist()
            yield from ((at, other) for other in close.tolist())
            if left and 2 * left < indexed:
                values, owners = index(np.flatnonzero(alive))
                indexed = left


def guests_linked(sets: list[np.ndarray], labels: list[int], guests: list[np.ndarray], their: list[int], least: tuple[int, int] = LEAST) -> Iterator[tuple[int, int]]:
    """(place of a guest, place in sets) of pairs at least that similar with different labels, one for each two labels."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    own, told = np.array(labels, np.int64), set()
    for g, x in enumerate(guests):
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = hi - lo
        found, shared = np.unique(owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], return_counts=True)
        close = found[(shared * least[1] >= (sizes[found] + len(x) - shared) * least[0]) & (own[found] != their[g])]
        for place in close.tolist():
            pair = min(labels[place], their[g]), max(labels[place], their[g])
            if pair not in told:
                told.add(pair)
                yield g, place


def _edges(dealt: DataFrame, compared: Callable[[list], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that `compared` finds among the rows (key, part, node, label, guest, shingles) of each key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, own, out = None, [], ([], [])

        def close() -> None:
            for a, b in compared(own) if len(own) > 1 else ():
                out[0].append(a)
                out[1].append(b)

        for batch in batches:
            for key, part, node, label, guest, packed in zip(*(batch.column(i) for i in range(6))):
                if (here := (key.as_py(), part.as_py())) != at:
                    close()
                    at, own = here, []
                own.append((node.as_py(), label.as_py(), guest.as_py(), np.frombuffer(packed.as_py(), np.uint64)))
            if len(out[0]) > 10_000:
                yield {"a": out[0], "b": out[1]}
                out = ([], [])
        close()
        yield {"a": out[0], "b": out[1]}

    sorted_ = dealt.select("key", "part", "node", "label", "guest", "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return mapped(sorted_, run, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _among(own: list) -> Iterator[tuple[int, int]]:
    for a, b in linked([x for *_, x in own]):
        yield own[a][0], own[b][0]


def _with_guests(own: list) -> Iterator[tuple[int, int]]:
    home, guests = [x for x in own if not x[2]], [x for x in own if x[2]]
    for g, k in guests_linked([x[3] for x in home], [x[1] for x in home], [x[3] for x in guests], [x[1] for x in guests]):
        yield guests[g][0], home[k][0]


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with the component of each node as label."""
    found = components(edges)
    return cut(rows.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))


def group_links(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all pairs of LEAST similarity or more within groups.

    members: key (of the group), node, size (of the set), shingles (packed, sorted), one row for each node of a group. A
    node is in one group. No rows give no edges.
    """
    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    heavy = cut(weights.filter(F.col("weight") > GROUP).select("key", F.ceil(2 * F.col("weight") / GROUP).alias("parts")))
    blank = {"part": F.lit(0).cast("long"), "label": F.col("node"), "guest": F.lit(False)}
    if not heavy.limit(1).count():
        return _edges(members.withColumns(blank), _among)
    told = members.join(small(heavy), "key", "left")
    edges = cut(_edges(told.filter("parts IS NULL").withColumns(blank), _among))
    rows = cut(told.filter("parts IS NOT NULL").withColumns(blank).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    inner = cut(_edges(rows, _among))
    edges, rows = cut(edges.union(inner)), _labelled(rows, inner)

    def invited(chosen: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All edges and labels after the chosen nodes have been guests of every part of their group but their own."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        sent = rows.join(chosen, "node", "left_semi").withColumns({"at_home": F.col("part"), "guest": F.lit(True)}).withColumn("part", every)
        sent = sent.filter("part <> at_home").drop("at_home")
        more = cut(_edges(rows.unionByName(sent), _with_guests))
        found = cut(found.union(more))
        return found, _labelled(rows, found)

    degrees = inner.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    best = Window.partitionBy("key", "part").orderBy(F.desc("links"), "node")
    pivots = rows.select("key", "part", "node").join(degrees, "node").withColumn("k", F.row_number().over(best)).filter(F.col("k") <= PIVOTS).select("node")
    edges, rows = invited(cut(pivots), edges)
    sizes = rows.groupBy("key", "label").count()
    giants = cut(sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("g")).select("key", F.col("g.label").alias("giant")))
    strangers = rows.join(small(giants), "key").filter(F.col("label") != F.col("giant")).select("node")
    return invited(cut(strangers), edges)[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id reachable through pairs of LEAST similarity or more),
    mark (XXH64 of the text by Spark), first (whether the row, or one like it in id and text, comes first in its component).

    First is the smallest doc_id, nulls last, then the smallest mark. Texts without words are copies of each other; null
    counts as empty. Rows with null ids link like any other; a component of such rows alone is null. Rows that repeat
    give a row each. An empty table gives no rows. Other columns are ignored. Ids may be of any type that can be ordered.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))
    kind = own.schema["doc_id"].dataType

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            node, fp, size, keys = [], [], [], []
            for x in batch.column(1):
                found = shingles(text := x.as_py() or "")
                node.append(signed(xxh64_intdigest(found.tobytes(), SEED)))
                fp.append(signed(fingerprint(text, SHINGLE)))
                size.append(len(found))
                keys.append(bands(found))
            yield {"doc_id": batch.column(0), "mark": batch.column(2), "node": node, "fp": fp, "size": size, "keys": keys}

    types = pa.schema([("doc_id", to_arrow_type(kind)), ("mark", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])
    each = cut(mapped(own, described, f"doc_id {kind.simpleString()}, mark long, node long, fp long, size long, keys array<long>", types))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    nodes = cut(each.groupBy("node").agg(F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))

    points = cut(nodes.select("fp").distinct())
    groups = components(links(points, points.count())).select(F.col("node").alias("fp"), "component")
    by_fp = nodes.select("node", "fp").join(groups, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"), "node")
    keyed = cut(nodes.select(F.explode("keys").alias("key"), "node").unionByName(by_fp))
    shared = cut(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least"))
    met = components(keyed.join(shared, "key").filter("node <> least").select("node", "least").toDF("a", "b"))
    met = cut(met.union(met.select("component", "component").distinct()).toDF("node", "key"))

    asked = nodes.select("node", "size", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")).join(met, "node")
    text = own.join(asked, F.col("mark").eqNullSafe(F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "node", "size", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                yield {"key": some.column(0), "node": some.column(1), "size": some.column(2), "shingles": [shingles(x.as_py() or "").tobytes() for x in some.column(3)]}

    members = mapped(text.dropDuplicates(["node"]), packed, "key long, node long, size long, shingles binary", pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("shingles", pa.binary())]))
    found = components(group_links(cut(members)))
    named = named_components(nodes.select("node", "first"), found)
    out = each.select("doc_id", "mark", "node").join(named, "node")
    return out.select("doc_id", F.col("component_id.doc_id").alias("component_id"), "mark", F.col("component_id").eqNullSafe(place).alias("first"))
