"""Token counts that follow edits without counting a document again.

A document's leaves are its pre-tokens, with their characters and tokens, in blocks of FILL to 2 * FILL; a segment tree
over the blocks holds the sums of both. An edit finds the pre-token that it begins in, goes back over as many characters
as a match of the pattern may look at (CONTEXT, and the white space before), and matches the pattern from there on until
a match ends behind the edit where an old leaf ended: from there on nothing changes. Only those pre-tokens are counted
again, a block that grows is split, and the sums above the blocks are updated. Trees are stored as bytes and take later
edits.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import MOST_BYTES, MOST_UNITS, Vocabulary, default, pack, vocabulary
from .common import mapped, table

#: Pre-tokens of a block; it's split when it has twice as many.
FILL = 64
#: Characters behind its end that decide where a match ends, white space apart: contractions look at two.
CONTEXT = 3
#: Bytes of new pre-tokens up to which the merging rule, pair by pair, is quicker than a replay over all of them.
FEW = 256

_PACKED = [n.to_bytes(4, "little") for n in range(512)]

Edit = tuple[int, int, str]


class Tree:
    """Pre-tokens in blocks, and sums over these; node k has children 2k and 2k + 1, block i is node n + i."""

    def __init__(self, text: str, chars: array, tokens: array) -> None:
        self.texts, self.chars, self.tokens = [], [], []
        at = 0
        for k in range(0, max(len(chars), 1), FILL):
            own = chars[k : k + FILL]
            end = at + sum(own)
            self.texts.append(text[at:end])
            self.chars.append(own)
            self.tokens.append(tokens[k : k + FILL])
            at = end
        self.recounted = 0
        self.build()

    def build(self) -> None:
        self.n = 1 << max(0, (len(self.texts) - 1).bit_length())
        blank = [0] * (self.n - len(self.texts))
        self.all_chars = [0] * self.n + [len(x) for x in self.texts] + blank
        self.all_tokens = [0] * self.n + [sum(x) for x in self.tokens] + blank
        for k in range(self.n - 1, 0, -1):
            self.all_chars[k] = self.all_chars[2 * k] + self.all_chars[2 * k + 1]
            self.all_tokens[k] = self.all_tokens[2 * k] + self.all_tokens[2 * k + 1]

    def update(self, block: int) -> None:
        k = self.n + block
        self.all_chars[k], self.all_tokens[k] = len(self.texts[block]), sum(self.tokens[block])
        while k > 1:
            k //= 2
            self.all_chars[k] = self.all_chars[2 * k] + self.all_chars[2 * k + 1]
            self.all_tokens[k] = self.all_tokens[2 * k] + self.all_tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.all_tokens[1]

    @property
    def n_leaves(self) -> int:
        return sum(map(len, self.chars))

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def block_of(self, at: int) -> tuple[int, int]:
        """The block with the character at a place (the last one beyond the end), and where it starts."""
        k, start = 1, 0
        while k < self.n:
            k *= 2
            if at >= start + self.all_chars[k] and self.all_chars[k + 1]:
                start += self.all_chars[k]
                k += 1
        return k - self.n, start

    def edit(self, edit: Edit, coder: Vocabulary) -> None:
        a, b, new = edit
        a = min(max(0, a), self.all_chars[1])
        b = min(max(a, b), self.all_chars[1])
        first, start = self.block_of(max(0, a - CONTEXT))
        while first and self.texts[first].isspace():  # a run of white space is one context
            first -= 1
            start -= len(self.texts[first])
        last, last_start = self.block_of(b)
        old = "".join(self.texts[first : last + 1])
        leaves = array("i", (x for block in self.chars[first : last + 1] for x in block))
        counts = array("i", (x for block in self.tokens[first : last + 1] for x in block))
        ends = list(accumulate(leaves))
        keep = bisect_right(ends, max(0, a - start - CONTEXT))  # leaves that end before the context
        while keep and (old[ends[keep - 1] - 1].isspace() or ends[keep - 1] > a - start - CONTEXT):
            keep -= 1
        if first and not keep:  # the context begins before this block: take the one before as well
            return self._wider(first - 1, edit, coder)
        self._match(first, last, start, old, leaves, counts, ends, keep, a, b, new, coder)

    def _wider(self, first: int, edit: Edit, coder: Vocabulary) -> None:
        """Edits with the blocks first and first + 1 made one, which is split again if it's large."""
        self.texts[first : first + 2] = ["".join(self.texts[first : first + 2])]
        self.chars[first : first + 2] = [self.chars[first] + self.chars[first + 1]]
        self.tokens[first : first + 2] = [self.tokens[first] + self.tokens[first + 1]]
        self.build()
        self.edit(edit, coder)

    def _match(self, first: int, last: int, start: int, old: str, leaves: array, counts: array, ends: list[int], keep: int, a: int, b: int, new: str, coder: Vocabulary) -> None:
        begin = ends[keep - 1] if keep else 0
        head, shift = old[:begin], len(new) - (b - a)
        rest = old[begin : a - start] + new + old[b - start :]
        beyond = a - start + len(new)  # where the edit ends, in the new block
        known, found, settled = set(ends), [], None
        while True:
            found.clear()
            for m in coder.pattern.finditer(rest):
                end = begin + m.end()
                found.append(m[0])
                if end >= beyond + 1 and end - shift in known and end < begin + len(rest) - CONTEXT and not rest[m.end() - 1].isspace():
                    settled = end - shift
                    break
            if settled is not None or last + 1 >= len(self.texts):
                break
            last += 1  # not in step with the old leaves before the block ends
            base = len(old)
            old += self.texts[last]
            rest += self.texts[last]
            leaves.extend(self.chars[last])
            counts.extend(self.tokens[last])
            ends += [base + x for x in accumulate(self.chars[last])]
            known.update(ends)
        after = len(ends) if settled is None else bisect_right(ends, settled)
        chars = leaves[:keep] + array("i", map(len, found)) + leaves[after:]
        tokens = counts[:keep] + array("i", sizes(coder, found)) + counts[after:]
        self.recounted += len(found)
        text, at, parts = head + rest, 0, []
        step = len(chars) if len(chars) <= 2 * FILL else FILL
        for k in range(0, max(len(chars), 1), max(step, 1)):
            own = chars[k : k + step]
            end = at + sum(own)
            parts.append((text[at:end], own, tokens[k : k + step]))
            at = end
        same = len(parts) == last + 1 - first
        for column, k in ((self.texts, 0), (self.chars, 1), (self.tokens, 2)):
            column[first : last + 1] = [p[k] for p in parts]
        if same:
            for k in range(first, last + 1):
                self.update(k)
        else:
            self.build()

    def dump(self) -> bytes:
        return pickle.dumps((self.texts, [x.tobytes() for x in self.chars], [x.tobytes() for x in self.tokens], self.recounted))

    @classmethod
    def load(cls, stored: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.texts, chars, tokens, tree.recounted = pickle.loads(stored)  # bytes that dump() made
        tree.chars, tree.tokens = [array("i", x) for x in chars], [array("i", x) for x in tokens]
        tree.build()
        return tree


def learned(coder: Vocabulary, words: Iterable[str]) -> None:
    """Sees to it that the vocabulary knows the pre-tokens: those of few bytes in all by the merging rule, more by replay."""
    waiting: dict[str, bytes] = {}
    size = 0

    def replayed() -> None:
        few = size < FEW
        coder.words.update(zip(waiting, [pack(coder.one(x)) for x in waiting.values()] if few else coder.replay(list(waiting.values()))))
        waiting.clear()

    for w in words:
        if w not in coder.words and w not in waiting:
            raw = w.encode("utf-8", "surrogatepass")
            coder.held += 2 * len(w)
            if (rank := coder.ranks.get(raw)) is not None:
                coder.words[w] = pack([rank])
            else:
                waiting[w] = raw
                size += len(raw)
                if size > MOST_BYTES:
                    replayed()
                    size = 0
    replayed()


def sizes(coder: Vocabulary, words: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    learned(coder, words)
    return [len(coder.words[w]) // 4 for w in words]


class Shapes:
    """Characters and tokens of the pre-tokens of each unit that a vocabulary has numbered, as packed integers."""

    def __init__(self, coder: Vocabulary) -> None:
        self.coder, self.chars, self.tokens = coder, [], []

    def trees(self, texts: list[str]) -> list[Tree]:
        coder = self.coder
        numbered = [coder.number(x) for x in texts]
        split = list(map(coder.pattern.findall, islice(coder.units, len(self.chars), None)))
        learned(coder, chain.from_iterable(split))
        words = coder.words
        for own in split:
            if len(own) == 1 and len(own[0]) < len(_PACKED) // 4:  # a pre-token has no more tokens than bytes
                self.chars.append(_PACKED[len(own[0])])
                self.tokens.append(_PACKED[len(words[own[0]]) >> 2])
            else:
                self.chars.append(array("i", map(len, own)).tobytes())
                self.tokens.append(array("i", [len(words[w]) >> 2 for w in own]).tobytes())
            coder.held += len(self.chars[-1])
        chars, tokens = self.chars.__getitem__, self.tokens.__getitem__
        return [Tree(x, array("i", b"".join(map(chars, own))), array("i", b"".join(map(tokens, own)))) for x, own in zip(texts, numbered)]

    def forget(self) -> None:
        self.coder.forget()
        if not self.coder.units:
            self.chars, self.tokens = [], []


@lru_cache(1)
def shaped(path: str, pattern: str) -> Shapes:
    """One for each Python worker, with a vocabulary that nothing else makes forget."""
    return Shapes(Vocabulary(path, pattern))


def recounted(coder: Vocabulary, texts: list[str], edits: list[list[Edit]]) -> tuple[list[Tree], list[int]]:
    """A tree of each text after its edits, and the tokens before."""
    trees = Shapes(coder).trees(texts)
    before = [tree.n_tokens for tree in trees]
    for tree, own in zip(trees, edits):
        for edit in own:
            tree.edit(edit, coder)
    return trees, before


def _edits(column: pa.Array) -> list[list[Edit]]:
    return [[(e["start"] or 0, e["stop"] or 0, e["new"] or "") for e in given or () if e] for given in column.to_pylist()]


_EDITS = "array<struct<start:int,stop:int,new:string>>"


def trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, tree (stored) of each row, to be kept and given to edited(). Nulls, repeats, empty tables and other columns as in counts()."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shapes = shaped(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                made = shapes.trees([x or "" for x in some.column(1).to_pylist()])
                yield {"doc_id": some.column(0), "n_tokens": [t.n_tokens for t in made], "tree": [t.dump() for t in made]}
                shapes.forget()

    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_tokens long, tree binary", pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("tree", pa.binary())]))


def edited(stored: DataFrame, path: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Rows of trees() after the edits of a column: doc_id, n_tokens, recounted (pre-tokens, in all edits so far), tree. A null tree is that of an empty text."""
    own = stored.select("doc_id", "tree", F.col(edits_col).cast(_EDITS).alias("edits"))
    kind = own.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = vocabulary(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                made = [Tree.load(x) if x else Tree("", array("i"), array("i")) for x in some.column(1).to_pylist()]
                for tree, edits in zip(made, _edits(some.column(2))):
                    for edit in edits:
                        tree.edit(edit, coder)
                coder.forget()
                yield {"doc_id": some.column(0), "n_tokens": [t.n_tokens for t in made], "recounted": [t.recounted for t in made], "tree": [t.dump() for t in made]}

    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_tokens long, recounted long, tree binary", pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("recounted", pa.int64()), ("tree", pa.binary())]))


def counts(docs: DataFrame, path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_edited (tokens after the edits), n_edits, n_leaves, recounted (pre-tokens) of each row.

    edits: array of structs (start, stop, new), each in code points of the text that the one before it leaves; places
    beyond the text's ends are moved to them, a null `new` is empty, null edits are none. Null and empty texts have no
    leaves. Repeated rows and ids give a row each; ids may be null. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(_EDITS).alias("edits"))
    kind = own.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shapes = shaped(path, pattern)
        for batch in batches:
            start, size = 0, 0
            for k in range(batch.num_rows):
                size += len(batch.column(1)[k].as_py() or "")
                if size < 4 * MOST_UNITS and k + 1 < batch.num_rows:
                    continue
                some = batch.slice(start, k + 1 - start)
                start, size = k + 1, 0
                made = shapes.trees([x or "" for x in some.column(1).to_pylist()])
                before, edits = [t.n_tokens for t in made], _edits(some.column(2))
                for tree, given in zip(made, edits):
                    for edit in given:
                        tree.edit(edit, shapes.coder)
                yield {"doc_id": some.column(0), "n_tokens": before, "n_edited": [t.n_tokens for t in made], "n_edits": list(map(len, edits)), "n_leaves": [t.n_leaves for t in made], "recounted": [t.recounted for t in made]}
                shapes.forget()

    names = ("n_tokens", "n_edited", "n_edits", "n_leaves", "recounted")
    types = pa.schema([("doc_id", to_arrow_type(kind)), *((n, pa.int64()) for n in names)])
    return mapped(own, rows, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names), types)


def sample_edits(text: Column) -> Column:
    """Three edits of a text, for want of a table of edits: a replacement, an insertion and a deletion."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    third, middle = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    one = lambda a, b, new: F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("new"))
    return F.array(one(third, third + 7, "edited it"), one(middle, middle, " (as amended) "), one(2 * third, 2 * third + 21, ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return counts(docs.select("doc_id", "text", sample_edits(F.col("text")).alias("edits")), *default())
