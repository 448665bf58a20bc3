"""Secret scans: patterns, and a convolutional network over characters for what they miss.

Every run of at least LEAST characters of the secrets' alphabet is a candidate, unless it's made of nothing but plain
words: letters in one case, perhaps with a capital, up to PLAIN at a stretch, joined by the alphabet's other signs. The
network (numpy alone) sees it with what stands before and after: one-hot characters, filters of WIDTH characters, their
largest values before, in and after the candidate, and a linear layer. Of a candidate that is longer than the network's
view every part is seen, and the likeliest counts. It's fitted to labelled findings: the different candidates of the whole
corpus, labelled by the patterns, and made-up ones of known shapes. Three quarters are dealt to shards; in each round every
shard goes on from the same network, over its own candidates and the made-up ones, and the networks are averaged. The
other quarter sets Platt's calibration, and the highest threshold that keeps RECALL of the positives.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, mapped, table
from .spans import Covered, Span, written

KINDS = ("assign", "access", "hex", "cnn")
#: Labelled candidates that one task fits a network to, made-up findings, share of the positives that the threshold keeps.
SHARD, MADE_UP, RECALL = 8_192, 2_400, 0.995
EPOCHS, RATE = 8, 0.02
#: Steps of a logit when held-out candidates are counted, and of a parameter when networks are averaged: sums are exact.
STEPS, PARTS = 256, 1 << 32
LEAST, PLAIN, BEFORE, INSIDE, AFTER, WIDTH, FILTERS = 8, 15, 24, 40, 8, 5, 16
#: Windows that the network reads at a time.
AT_ONCE = 8_192
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(f"[A-Za-z0-9+/_.=-]{{{LEAST},}}+")
_PLAIN = re.compile(f"[+/_.=-]*+(?:(?:[A-Z]?[a-z]{{1,{PLAIN}}}+|[A-Z]{{2,{PLAIN}}}+|[A-Z])(?:[+/_.=-]++|$))*+")
_WORDS = ("passw", "secret", "token", "api")
#: Code 0 is nothing, 1 any other character.
_CODES = np.ones(128, np.int64)
for _k, _c in enumerate(string.ascii_letters + string.digits + " \"'=:;,.-_/+()[]{}<>@#&|\n\t"):
    _CODES[ord(_c)] = 2 + _k
CODES = int(_CODES.max()) + 1


def patterned(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its test are dropped without another try."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text) if not _PLAIN.fullmatch(m[0])]


def window(text: str, a: int, b: int) -> str:
    """Fixed length: what stands before, up to INSIDE characters from a on, what stands after; padded with NUL."""
    return text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b].ljust(INSIDE, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")


def windows(text: str, a: int, b: int) -> Iterator[str]:
    """Windows that see all of a candidate: one, or several that overlap by half."""
    for at in range(a, max(a + 1, b - INSIDE // 2), INSIDE // 2):
        yield window(text, at, min(b, at + INSIDE))


def encoded(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), BEFORE + INSIDE + AFTER)
    return np.where(points == 0, 0, np.where(points < 128, _CODES[np.minimum(points, 127)], 1))


@dataclass
class Network:
    table: np.ndarray  # WIDTH, CODES, FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    #: Places of the filters' outputs in the three regions; the filter reaches WIDTH // 2 to either side.
    REGIONS = ((0, BEFORE - WIDTH + 1), (BEFORE - WIDTH // 2, BEFORE + INSIDE - WIDTH // 2), (BEFORE + INSIDE - WIDTH // 2, BEFORE + INSIDE + AFTER - WIDTH + 1))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = x.shape[1] - WIDTH + 1
        z = np.broadcast_to(self.bias, (len(x), places, FILTERS)).copy()
        for k in range(WIDTH):
            z += self.table[k][x[:, k : k + places]]
        at = np.stack([a + z[:, a:b].argmax(1) for a, b in self.REGIONS], 1)  # n, 3, FILTERS
        top = np.take_along_axis(z, at.reshape(len(x), -1, FILTERS), 1)
        return np.maximum(top, 0).reshape(len(x), -1), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.pooled(x[k : k + 1024])[0] @ self.out for k in range(0, len(x), 1024)]
        return np.concatenate(parts) + self.out_bias if parts else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


NAMES = ("table", "bias", "out")


class Fit:
    """A network and Adam's moments. Seeds make the first one the same everywhere."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.net = Network(rng.normal(0, 0.1, (WIDTH, CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS))
        self.m = {c: np.zeros_like(getattr(self.net, c)) for c in NAMES}
        self.v = {c: np.zeros_like(getattr(self.net, c)) for c in NAMES}
        self.step = 0

    def go_over(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One pass over the rows in their order."""
        net = self.net
        for k in range(0, len(x), 128):
            own, want = x[k : k + 128], y[k : k + 128]
            top, at = net.pooled(own)
            g = (1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias, -30, 30))) - want) * weight[k : k + 128] / len(own)
            back = (g[:, None] * net.out * (top > 0)).reshape(at.shape)
            grad = {"out": top.T @ g + 1e-4 * net.out, "bias": back.sum((0, 1)), "table": 1e-4 * net.table}
            filters = np.broadcast_to(np.arange(FILTERS), at.shape)
            for w in range(WIDTH):
                codes = np.take_along_axis(own, (at + w).reshape(len(own), -1), 1).reshape(at.shape)
                np.add.at(grad["table"][w], (codes, filters), back)
            net.out_bias -= rate * float(g.sum())
            self.step += 1
            for c in NAMES:
                self.m[c] = 0.9 * self.m[c] + 0.1 * grad[c]
                self.v[c] = 0.999 * self.v[c] + 0.001 * grad[c] ** 2
                getattr(net, c)[...] -= rate * (self.m[c] / (1 - 0.9**self.step)) / (np.sqrt(self.v[c] / (1 - 0.999**self.step)) + 1e-8)

    def flat(self) -> np.ndarray:
        """All parameters and moments, and the number of steps."""
        return np.concatenate([*(x[c].ravel() for x in (vars(self.net), self.m, self.v) for c in NAMES), [self.net.out_bias, self.step]])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (vars(self.net), self.m, self.v):
            for c in NAMES:
                x[c] = flat[at : at + x[c].size].reshape(x[c].shape).copy()
                at += x[c].size
        self.net.out_bias, self.step = float(flat[-2]), max(1, round(flat[-1]))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> Network:
    """Adam on three quarters of the rows; the rest calibrates and sets the threshold."""
    rng = np.random.default_rng(seed)
    own = Fit(rng)
    order = rng.permutation(len(x))
    held, use = order[: len(x) // 4], order[len(x) // 4 :]
    for _ in range(epochs):
        use = rng.permutation(use)
        own.go_over(x[use], y[use], np.ones(len(use)), rate)
    settle(own.net, own.net.logits(x[held]), y[held], np.ones(len(held)))
    return own.net


def settle(net: Network, s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Calibration and threshold by logits s of held-out rows: the least positive one of those that RECALL needs."""
    net.scale, net.shift = platt(s, y, weight)
    order = np.argsort(s, kind="stable")
    s, lost = s[order], np.cumsum((weight * y)[order])
    net.threshold = 1.0
    if len(s) and lost[-1]:
        least = s[np.searchsorted(lost, (1 - RECALL) * lost[-1], "right")]
        net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale * least + net.shift, -30, 30))))


def platt(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic fit of y to s with smoothed labels, by damped Newton steps."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r, off = weight * (p * (1 - p) + 1e-6), weight * (p - t)
        h = np.array([[(r * s * s).sum() + 1e-3, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(off * s).sum(), off.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def made_up(n: int = MADE_UP, seed: int = 3) -> tuple[list[str], list[int]]:
    """Windows of findings of known shapes, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: pick("abcdefghilmnoprstuvz", int(rng.integers(3, 9)))
    alnum, digits = string.ascii_letters + string.digits, string.digits
    secret = (
        lambda: pick("0123456789abcdef", int(rng.integers(24, 65))),
        lambda: pick(alnum + "+/", int(rng.integers(20, 60))) + pick("=", int(rng.integers(0, 3))),
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16),
        lambda: pick(string.ascii_lowercase, 3) + "_" + pick(alnum, 36),
        lambda: ".".join(pick(alnum + "-_", int(rng.integers(16, 30))) for _ in range(3)),
        lambda: pick(string.ascii_letters, int(rng.integers(16, 44))),
        lambda: pick(alnum + "+/-_", int(rng.integers(10, 20))),
    )
    plain = (
        lambda: pick(digits, int(rng.integers(12, 20))),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}",
        lambda: f"{word()}/{word()}/{word()}{rng.integers(0, 99)}.{word()}",
        lambda: f"{word()}_{word()}_{word()}{rng.integers(0, 99)}",
        lambda: f"{word()}.{word()}-{rng.integers(1, 20)}.{rng.integers(0, 30)}.{rng.integers(0, 99)}",
        lambda: f"{word()}{word()}{word()}{rng.integers(0, 9999)}",
        lambda: pick("=-_.", 1) * int(rng.integers(12, 40)) + str(rng.integers(0, 9)),
        lambda: f"{rng.integers(0, 24):02d}/{rng.integers(1, 12):02d}/{rng.integers(1990, 2030)}",
        lambda: f"{rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}",
        lambda: f"{word()}{word().capitalize()}{word().capitalize()}",
        lambda: f"{word()}{word()}{word()}{word()}",
        lambda: f"www.{word()}{rng.integers(0, 99)}.example.com/{word()}",
        lambda: f"{rng.integers(100, 255)}.{rng.integers(100, 255)}.{rng.integers(10, 255)}.{rng.integers(10, 255)}",
    )
    keyed = ('key: "', "secret = ", 'Authorization: Bearer ', "token=", 'password: "', "credential: ")
    shown, labels = [], []
    for k in range(n):
        label = k % 2
        shapes = secret if label else plain
        own = shapes[int(rng.integers(len(shapes)))]()
        before = " ".join(word() for _ in range(5)) + " "
        if label and rng.random() < 0.6:
            before += keyed[int(rng.integers(len(keyed)))]
        text = before + own + (' "' if before.endswith('"') else " ") + word()
        for w in windows(text, len(before), len(before) + len(own)):
            shown.append(w)
            labels.append(label)
    return shown, labels


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(window, label) of all candidates of the corpus, each once: 1 if a pattern covers the candidate."""
    own = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.length("text") >= LEAST)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = set()
            for x in batch.column(0):
                text = x.as_py()
                covered = Covered(patterned(text))
                found.update((w, int(covered.meets(a, b))) for a, b in candidates(text) for w in windows(text, a, b))
            yield {"window": [w for w, _ in found], "label": [y for _, y in found]}

    return mapped(own, rows, "window string, label int", pa.schema([("window", pa.string()), ("label", pa.int32())])).distinct()


def train(docs: DataFrame, text_col: str = "text", seed: int = 5) -> Network:
    """Labels of the corpus come from patterned(): candidates that it covers are secrets, the others aren't. All count.

    Of each label the corpus weighs as much as the made-up findings in every shard at most. Null, empty and repeated texts,
    ids, other columns and the partitions don't matter; an empty table leaves the made-up findings.
    """
    shown, labels = made_up()
    made, truth = encoded(shown), np.array(labels, np.float64)
    all_ = cut(labelled(docs, text_col).withColumn("h", F.xxhash64("window")))
    counts = {(r.held, r.label): r["count"] for r in all_.groupBy((F.pmod("h", F.lit(4)) == 0).alias("held"), "label").count().collect()}
    total = counts.get((False, 0), 0) + counts.get((False, 1), 0)
    if not total:
        return fit(made, truth, seed)
    shards = -(-total // SHARD)
    order = np.random.default_rng(seed).permutation(len(made))
    kept, use = order[: len(made) // 4], order[len(made) // 4 :]
    made, truth, spare, their = made[use], truth[use], made[kept], truth[kept]
    share = np.array([min(1.0, float((truth == c).sum()) * shards / max(1, counts.get((False, c), 0))) for c in (0, 1)])
    dealt = all_.filter(F.pmod("h", F.lit(4)) != 0).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    dealt = cut(dealt.select("shard", "window", "label", "h").repartition("shard").sortWithinPartitions("shard", "h", "window", "label"))
    own = Fit(np.random.default_rng(seed))
    for turn in range(EPOCHS):
        sums = _round(dealt, own, turn, seed, made, truth, share)
        flat = np.zeros(len(own.flat()))
        for r in sums.collect():
            flat[r.place] = int(r.total) / (total * PARTS)
        own.put(flat)
    net = own.net
    held = _counted(all_.filter(F.pmod("h", F.lit(4)) == 0), net).collect()
    s = np.concatenate([np.array([r.step / STEPS for r in held]), net.logits(spare)])
    y = np.concatenate([np.array([r.label for r in held], np.float64), their])
    settle(net, s, y, np.concatenate([np.array([r["count"] * share[r.label] / shards for r in held]), np.ones(len(their))]))
    return net


def _round(dealt: DataFrame, own: Fit, turn: int, seed: int, made: np.ndarray, truth: np.ndarray, share: np.ndarray) -> DataFrame:
    """(place, total) of each parameter: the sum over all shards, each by its rows, in whole PARTS. dealt: sorted by shard."""
    start, made = own.flat(), made.astype(np.uint8)
    kind = "place int, total long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, windows, labels, done = None, [], [], 0
        sums = np.zeros(len(start), np.int64)

        def close() -> None:
            nonlocal done
            if not windows:
                return
            done += 1
            one, y = Fit(np.random.default_rng(seed)), np.array(labels)
            one.put(start) if turn else None
            x, want = np.concatenate([encoded(windows), made.astype(np.int64)]), np.concatenate([y, truth])
            order = np.random.default_rng([seed, turn, at]).permutation(len(x))
            one.go_over(x[order], want[order], np.concatenate([share[y], np.ones(len(truth))])[order], RATE)
            sums[...] += len(y) * np.rint(one.flat() * PARTS).astype(np.int64)

        for batch in batches:
            for shard, window_, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != at:
                    close()
                    at, windows, labels = shard, [], []
                    if done == 64:  # before the sums outgrow 64 bits
                        yield {"place": np.arange(len(sums), dtype=np.int32), "total": sums.copy()}
                        sums[...] = done = 0
                windows.append(window_)
                labels.append(label)
        close()
        some = np.flatnonzero(sums)
        yield {"place": some.astype(np.int32), "total": sums[some]}

    found = mapped(dealt.select("shard", "window", "label"), rows, kind, pa.schema([("place", pa.int32()), ("total", pa.int64())]))
    return found.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _counted(held: DataFrame, net: Network) -> DataFrame:
    """(step, label, count): how many held-out candidates have a logit from step / STEPS up to the next."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            s = np.clip(net.logits(encoded(batch.column(0).to_pylist())), -30, 30)
            yield {"step": np.floor(s * STEPS).astype(np.int32), "label": batch.column(1)}

    found = mapped(held.select("window", "label"), rows, "step int, label int", pa.schema([("step", pa.int32()), ("label", pa.int32())]))
    return found.groupBy("step", "label").count()


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (the patterns' spans as text), spans (with the network's) of each row.

    The network's spans are candidates from its threshold on that no pattern covers. Null and empty texts have none.
    Repeated rows and ids give a row each; ids may be null. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        net = shared.value
        for batch in batches:
            base, found, waiting = [], [], []

            def seen() -> None:
                p = net.probability(encoded([w for *_, w in waiting]))
                for j in np.flatnonzero(p >= net.threshold).tolist():
                    k, a, b, _ = waiting[j]
                    found[k].add((a, b, 3))
                waiting.clear()

            for k, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                base.append(patterned(text))
                found.append(set())
                covered = Covered(base[-1])
                for a, b in candidates(text):
                    if not covered.meets(a, b):
                        for w in windows(text, a, b):
                            waiting.append((k, a, b, w))
                            if len(waiting) >= AT_ONCE:
                                seen()
            seen()
            counts = {f"n_{KINDS[c]}": [sum(s[2] == c for s in x) for x in base] for c in range(3)}
            yield {"doc_id": batch.column(0), **counts, "base": [written(x, KINDS) for x in base], "spans": [written([*x, *more], KINDS) for x, more in zip(base, found)]}

    types = pa.schema([("doc_id", to_arrow_type(kind)), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base", pa.string()), ("spans", pa.string())])
    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_assign long, n_access long, n_hex long, base string, spans string", types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the query that SQL can say: how many base spans of each kind a text has."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).select("doc_id", "n_assign", "n_access", "n_hex")


SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda m: length(m) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda m: length(m) >= 32)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
