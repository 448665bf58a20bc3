"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a part of the corpus.

The words of many documents are laid end to end. An inverted index leads from each mergeable pair of tokens, by its
rank, to the places where it occurs; merges are applied in rank order to all words at once, and only the neighbours
of a merged place get new entries. Words don't influence each other, so replaying the words of a part of the corpus
gives the ids that replaying the whole corpus gives; a part is what one task reads, and each distinct word is
replayed once for as long as it's remembered.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import mapped, table

#: Unicode's White_Space, as a set for regular expressions.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of a pattern of this family crosses the ends of such a unit, and a unit's matches don't depend on what is around it.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
BREAK = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")
#: Texts are cut into pieces of about this many characters, words are remembered up to as many, and results are passed on at as many bytes.
PIECE, MEMORY, BLOCK = 1 << 20, 8 << 20, 2 << 20
#: Units that are numbered before their words are replayed, and bytes of words that are replayed at once.
MOST_UNITS, MOST_BYTES = 1 << 20, 1 << 20
NONE = np.iinfo(np.int32).max


class Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Vocabulary:
    """Ranks of a tiktoken file, and the pattern whose matches are encoded separately."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        found = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        found.sort()
        self.pair_keys = np.array([k for k, _ in found] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in found] + [NONE], np.int32)
        self.units = Numbered()
        self.packed: list[bytes] = []
        self.words: dict[str, bytes] = {}
        self.held = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the tokens that a and b make, or NONE."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word. Of equal ranks in a word the leftmost comes first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        ids = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        filled = lengths > 0
        after[ends[filled] - 1] = before[(ends - lengths)[filled]] = -1
        due = np.full(n, NONE, np.int32)  # rank of the pair that starts at a place
        inner = np.flatnonzero(after >= 0)
        due[inner] = self.rank(ids[inner], ids[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = due[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, own in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        def start(places: np.ndarray) -> None:
            places = places[due[places] != NONE]
            if len(places):
                enter(places)

        start(inner)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            own = index.pop(r)
            at = np.sort(np.concatenate(own))
            at = at[due[at] == r]  # else merged away meanwhile
            if len(at) > 1:
                at = at[np.append(True, np.diff(at) > 0)]
                if (after[at[:-1]] == at[1:]).any():
                    at = _leftmost(at, after)
            if not len(at):
                continue
            second = after[at]
            third = after[second]
            ids[at], ids[second], due[second] = r, -1, NONE
            after[at] = third
            more = third >= 0
            before[third[more]] = at[more]
            due[at] = NONE
            if more.any():
                due[at[more]] = self.rank(ids[at[more]], ids[third[more]])
            first = before[at]
            first = first[first >= 0]
            if len(first):
                due[first] = self.rank(ids[first], ids[after[first]])
            new = np.concatenate((at, first))
            early = new[due[new] <= r]
            if len(early):  # due before what is left of this rank; only odd vocabularies have that
                odd.append(early)
            start(new)
        left = np.flatnonzero(ids >= 0)
        cuts = np.concatenate(([0], np.searchsorted(left, ends))).tolist()
        packed = ids[left].astype("<u4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
        for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else ():
            out[w] = pack(self.one(words[w]))
        return out

    def one(self, word: bytes) -> list[int]:
        """The rule itself: merge the leftmost pair of lowest rank until there is none."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            found = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[i + 1]])) is not None]
            if not found:
                break
            r, i = min(found)
            ids[i : i + 2] = [r]
        return ids

    def learn(self) -> None:
        """Packs the ids of the units that were numbered since the last time."""
        known, waiting, size = len(self.packed), {}, 0

        def replayed() -> None:
            self.words.update(zip(waiting, self.replay(list(waiting.values()))))
            waiting.clear()

        for unit in islice(self.units, known, None):
            self.held += 2 * len(unit)
            for w in self.pattern.findall(unit):
                if w not in self.words and w not in waiting:
                    raw = w.encode("utf-8", "surrogatepass")
                    if (r := self.ranks.get(raw)) is not None:
                        self.words[w] = pack([r])
                    else:
                        waiting[w] = raw
                        size += len(raw)
            if size > MOST_BYTES:
                replayed()
                size = 0
        replayed()
        get = self.words.__getitem__
        self.packed += [b"".join(map(get, self.pattern.findall(unit))) for unit in islice(self.units, known, None)]

    def number(self, text: str) -> array:
        """The numbers of the text's units; encode() turns them into ids."""
        number = self.units.__getitem__
        return array("i", chain.from_iterable(map(number, UNIT.findall(x)) for x in pieces(text)))

    def encode(self, numbered: list[array]) -> Iterator[bytes]:
        """Packed ids of each text; numbers hold until forget()."""
        self.learn()
        get = self.packed.__getitem__
        for numbers in numbered:
            yield b"".join(map(get, numbers))

    def forget(self) -> None:
        """Drops what is remembered if it's much."""
        if self.held > MEMORY:
            self.units.clear()
            self.words.clear()
            self.packed, self.held = [], 0

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I").tolist()))


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places without those that start where the pair of the place before ends."""
    keep, ahead = [], -1
    for i, j in zip(at.tolist(), after[at].tolist()):
        if i != ahead:
            keep.append(i)
            ahead = j
    return np.array(keep, at.dtype)


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return b"".join([x.to_bytes(4, "little") for x in ids])


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path, pattern)


def pieces(text: str) -> Iterator[str]:
    """The text, cut where a unit ends."""
    at = 0
    while len(text) - at > 2 * PIECE and (m := BREAK.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are packed as little-endian unsigned 32-bit integers; see unpack().

    Null and empty texts have no ids. Repeated rows give a row each; ids of documents may be null. An empty table gives
    no rows. Other columns are ignored, whatever their names. Texts of any length are read piece by piece.
    """
    own, kind = _own(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, packed in encoded(batches, vocabulary(path, pattern)):
            yield {"doc_id": ids, "n_tokens": [len(x) // 4 for x in packed], "ids": packed}

    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_tokens long, ids binary", pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.binary())]))


def _own(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataType]:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own, own.schema["doc_id"].dataType


def encoded(batches: Iterator[pa.RecordBatch], coder: Vocabulary) -> Iterator[tuple[list, list[bytes]]]:
    """(ids of documents, packed ids of their texts), some documents at a time."""

    def emit(ids: list, numbered: list[array]) -> Iterator[tuple[list, list[bytes]]]:
        own, out, size = [], [], 0
        for doc_id, packed in zip(ids, coder.encode(numbered)):
            own.append(doc_id)
            out.append(packed)
            size += len(packed)
            if size > BLOCK:
                yield own, out
                own, out, size = [], [], 0
        yield own, out
        coder.forget()

    ids, numbered, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            numbered.append(coder.number(text.as_py() or ""))
            size += len(numbered[-1])
            if size > MOST_UNITS:
                yield from emit(ids, numbered)
                ids, numbered, size = [], [], 0
    yield from emit(ids, numbered)


def decode(packed: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of encode() with their bytes in `decoded`. Null ids decode to no bytes; repeated rows give a row each; an empty table none."""
    own = packed.select("doc_id", "n_tokens", "ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = vocabulary(path, pattern)
        for batch in batches:
            start, size = 0, 0
            for k in range(batch.num_rows):
                size += 4 * (batch.column(1)[k].as_py() or 0)
                if size > BLOCK or k == batch.num_rows - 1:
                    some = batch.slice(start, k + 1 - start)
                    yield {**{c: some.column(c) for c in ("doc_id", "n_tokens", "ids")}, "decoded": [coder.decode(x.as_py() or b"") for x in some.column(2)]}
                    start, size = k + 1, 0

    kind = own.schema["doc_id"].dataType
    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_tokens long, ids binary, decoded binary", pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]))


def unpack(ids: str = "ids"):  # noqa: ANN201
    """Column with packed ids as an array of integers."""
    flip = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    n = (F.length(F.col(ids)) / 4).cast("int")
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(place, lambda i: F.conv(flip(F.hex(F.substring(F.col(ids), i * 4 + 1, F.lit(4)))), 16, 10).cast("int"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() in one pass of Python workers.

    Nulls, empty and long texts, repeated rows, empty tables and other columns are treated as by encode().
    """
    own, kind = _own(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = vocabulary(path, pattern)
        for ids, packed in encoded(batches, coder):
            yield {"doc_id": ids, "n_tokens": [len(x) // 4 for x in packed], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed], "decoded_sha256": [hashlib.sha256(coder.decode(x)).hexdigest() for x in packed]}

    types = pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", types)


def default() -> tuple[str, str]:
    """The public multilingual vocabulary and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default())
