"""Toxicity by a factorization machine over hashed terms.

score = w0 + sum_i w_i + sum_{i<j} <v_i, v_j> over a text's distinct terms: pairs that mean more together than apart,
such as an insult with a group's name, get a weight of their own. Terms are hashed to SPACE slots; a slot has a weight
and factors if it tells the classes apart in the sample alone, or with another slot better than either alone, whatever
the two say apart. The model is fitted on a bounded sample of labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, texts

#: Labelled rows to fit on at most, the first by hash of their id; a quarter of them sets the threshold.
SAMPLE = 12_000
#: Slots that terms are hashed to, those that get parameters at most, factors of each, and the score that predicts 1.
SPACE, TERMS, FACTORS, THRESHOLD = 1 << 20, 8_192, 4, 0.3
#: Smallest number of sampled texts, and smallest z score, with which a slot gets parameters for itself, and for a pair.
LEAST, LEAST_Z, PAIR_LEAST, PAIR_Z = 3, 3.0, 10, 7.0
#: Rows of a step, passes over the rows, step size, and pull of weights and factors towards zero.
STEP, EPOCHS, RATE, PULL = 8, 24, 0.05, 1e-3
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str, known: dict[str, int]) -> set[int]:
    """Slots of the text's distinct terms; known: a memory of them, emptied when it's full."""
    out = set()
    for term in set(_TERM.findall(text.lower())):
        if (h := known.get(term)) is None:
            if len(known) > 200_000:
                known.clear()
            h = known[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) % SPACE
        out.add(h)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    #: Slots with parameters, ascending.
    slots: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    #: From raw score to log odds, so that THRESHOLD is where the calibration rows are told apart best.
    scale: float = 1.0
    shift: float = 0.0

    def places(self, found: set[int] | np.ndarray) -> np.ndarray:
        own = np.sort(np.fromiter(found, np.int64, len(found)))
        at = np.searchsorted(self.slots, own)
        near = np.minimum(at, max(len(self.slots) - 1, 0))
        return at[(at < len(self.slots)) & (self.slots[near] == own)] if len(self.slots) else at[:0]

    def raw(self, places: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(places), self.w0)
        for k, x in enumerate(places):
            if len(x):
                v = self.v[x]
                out[k] += self.w[x].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return out

    def score(self, found: list[set[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw([self.places(x) for x in found]) * self.scale + self.shift, -30, 30)))


def telling(found: list[np.ndarray], y: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The slots that get parameters, ascending: the `most` with the largest z score, their own or that of a pair.

    A slot's own score measures its share of toxic texts against all texts' share; a pair's (the signed root of the
    likelihood ratio, as there are many pairs) measures the share of the texts with both against that of whichever of the
    two comes nearer to it, so that a pair counts for what it says beyond its slots. Counts of pairs are taken slot by
    slot, over the texts that have it.
    """
    every = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
    slots, at, count = np.unique(every, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    hit, p = np.bincount(at, y[rows], len(slots)), float(y.mean())
    z = np.abs(hit - count * p) / np.sqrt(count * p * (1 - p))
    z[(count < LEAST) | (z < LEAST_Z)] = 0
    able = np.flatnonzero(count >= PAIR_LEAST)
    number = np.full(len(slots), -1)
    number[able] = np.arange(len(able))
    kept = number[at] >= 0
    at, rows = number[at[kept]], rows[kept]
    starts = np.searchsorted(rows, np.arange(len(found) + 1))
    order = np.argsort(at, kind="stable")
    having = np.split(rows[order], np.cumsum(np.bincount(at, minlength=len(able)))[:-1]) if len(able) else []
    share = (hit[able] + p) / (count[able] + 1)  # smoothed
    pair_z = np.zeros(len(able))
    for i, own in enumerate(having):
        there = np.concatenate([at[starts[r] : starts[r + 1]] for r in own])
        both = np.bincount(there, minlength=len(able))
        both[i] = 0
        js = np.flatnonzero(both >= PAIR_LEAST)
        if not len(js):
            continue
        n = both[js]
        toxic_rows = own[y[own] > 0]
        t = np.bincount(np.concatenate([at[starts[r] : starts[r + 1]] for r in toxic_rows]), minlength=len(able))[js] if len(toxic_rows) else np.zeros(len(js))
        high, low = np.maximum(np.maximum(share[i], share[js]), p), np.minimum(np.minimum(share[i], share[js]), p)
        q = np.clip(np.where(t > n * high, high, np.where(t < n * low, low, t / n)), 1e-9, 1 - 1e-9)
        own_z = np.sqrt(np.maximum(0, 2 * (t * np.log(np.maximum(t, 1e-9) / (n * q)) + (n - t) * np.log(np.maximum(n - t, 1e-9) / (n * (1 - q))))))
        pair_z[i] = max(pair_z[i], own_z.max())
        np.maximum.at(pair_z, js, own_z)
    pair_z[pair_z < PAIR_Z] = 0
    z[able] = np.maximum(z[able], pair_z)
    chosen = np.flatnonzero(z > 0)
    return np.sort(slots[chosen[np.argsort(-z[chosen], kind="stable")][:most]]).astype(np.int64)


def fit(found: list[np.ndarray], labels: np.ndarray, seed: int = 7, most: int = TERMS) -> Model:
    """Fits by Adagrad on three quarters of the rows; the rest calibrates. Without both classes the score is constant."""
    logit = lambda p: float(np.log(p / (1 - p)))
    y = np.asarray(labels, np.float64)
    n, positive = len(y), float(np.sum(y))
    if n == 0 or positive in (0, n):
        return Model(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)), 0.0, -6.0 if positive == 0 else 6.0)
    tuned = np.arange(n) % 4 == 3
    if not 0 < y[tuned].sum() < tuned.sum() or not 0 < y[~tuned].sum() < (~tuned).sum():
        tuned[:] = False
    use = np.flatnonzero(~tuned)
    slots = telling([np.asarray(found[i], np.int64) for i in use], y[use], most)
    rng = np.random.default_rng(seed)
    model = Model(slots, logit(y[use].mean()), np.zeros(len(slots)), rng.normal(0, 0.01, (len(slots), FACTORS)))
    places = [model.places(x) for x in found]
    gw, gv, g0 = np.full(len(slots), 1e-3), np.full((len(slots), FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(use)
        for k in range(0, len(order), STEP):
            rows = order[k : k + STEP]
            lengths = np.array([len(places[i]) for i in rows])
            x = np.concatenate([places[i] for i in rows])
            own = np.repeat(np.arange(len(rows)), lengths)
            v, total = model.v[x], np.zeros((len(rows), FACTORS))
            np.add.at(total, own, v)
            s = model.w0 + np.bincount(own, model.w[x], len(rows)) + 0.5 * ((total**2).sum(1) - np.bincount(own, (v**2).sum(1), len(rows)))
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[rows]
            g0 += float(g.sum()) ** 2
            model.w0 -= RATE * float(g.sum()) / np.sqrt(g0)
            x, at = np.unique(x, return_inverse=True)
            dw = np.bincount(at, g[own], len(x)) + PULL * model.w[x]
            dv = np.stack([np.bincount(at, g[own] * (total[own, f] - v[:, f]), len(x)) for f in range(FACTORS)], 1) + PULL * model.v[x]
            gw[x] += dw**2
            gv[x] += dv**2
            model.w[x] -= RATE * dw / np.sqrt(gw[x])
            model.v[x] -= RATE * dv / np.sqrt(gv[x])
    check = np.flatnonzero(tuned) if tuned.any() else use
    s, t = model.raw([places[i] for i in check]), y[check]
    model.scale, model.shift = _platt(s, t)
    # the cut with the best F1, between two neighbouring scores, is put at THRESHOLD; half of what it takes must be toxic
    order = np.argsort(-s, kind="stable")
    true, taken = np.cumsum(t[order]), np.arange(1, len(t) + 1)
    fair = np.append(np.diff(s[order]) < 0, True) & (2 * true >= taken)
    if fair.any():
        best = int(np.flatnonzero(fair)[np.argmax((2 * true / (taken + t.sum()))[fair])])
        below = s[order][best + 1] if best + 1 < len(s) else s[order][best] - 1
        at = (s[order][best] + below) / 2
    else:
        at = s.max() + 1
    model.shift = logit(THRESHOLD) - model.scale * at
    return model


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above zero) and intercept of the logistic fit of y to s, by Newton steps with smoothed labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((p - t) * s).sum(), (p - t).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * s * s).sum() + 1e-6, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 1e-3 and np.isfinite(a + b) else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = TERMS) -> Model:
    """A model of `most` slots at most, from at most `sample` labelled ids that are not held out.

    An id labelled twice counts as toxic if either is; of several rows with one id the first by its slots is taken. Null
    ids and labels are left out, null texts count as empty; without labels of both kinds the score is constant. Other
    columns don't matter. Ids may be of any type.
    """
    marked = labels.select(F.col(id_col).cast("string").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.join(F.broadcast(marked), "doc_id").select("label", "text", "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [np.array(sorted(terms(x, known)), np.uint32).tobytes() for x in texts(batch)]
            yield {"doc_id": batch.column(2), "label": batch.column(0), "terms": found}

    schema = pa.schema([("doc_id", pa.string()), ("label", pa.int32()), ("terms", pa.binary())])
    got = mapped(own, rows, "doc_id string, label int, terms binary", schema)
    got = got.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms"))  # `sample` rows of SPACE slots at most

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = sorted(((len(i), i, y, x) for batch in batches for i, y, x in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[:2])
        yield {"model": [pickle.dumps(fit([np.frombuffer(x, np.uint32) for *_, x in found], np.array([y > 0 for *_, y, _ in found]), most=most))]}

    one = mapped(got.repartition(1), fitted, "model binary", pa.schema([("model", pa.binary())])).first()
    return pickle.loads(one["model"])  # bytes that the task made


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier) and predicted (1 from THRESHOLD on); null texts count as empty.

    Every row stays, also repeated ones; ids don't matter. Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # TERMS slots of FACTORS + 2 numbers at most

    @F.pandas_udf("double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pd.Series(shared.value.score([terms(x or "", known) for x in batch]), index=batch.index)

    out = docs.withColumn("score", rated(F.col(text_col).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
