"""Personal data: patterns, and the terms that reveal them by what the whole corpus says.

Entities are emails, IP addresses, card and phone numbers. A word position is *near* a kind if at most WINDOW words
lie between it and an entity of that kind. Over all positions p(kind) is the share near the kind, p(kind | term) that
of the term's own positions. A term's pointwise mutual information log(p(kind | term) / p(kind)) can't exceed the
kind's information -log p(kind), which it reaches when the term gives the kind away. A term near an entity is
generalised from GENERALISE of that on and removed from REMOVE on.

Every term near LEAST entities of a kind counts, however large the corpus is; totals meet them in a shuffle. What is
removed is so wherever it stands, also where no pattern finds the entity; what is generalised only near an entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, mapped, table
from .spans import Covered, Span, masked, written

KINDS = ("email", "ip", "card", "phone", "term")
#: What stands in for each kind of span; 4 and more generalise a term to the kind that it reveals, the last removes it.
MASKS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[EMAIL TERM]", "[IP TERM]", "[CARD TERM]", "[PHONE TERM]", ""]
GONE = len(MASKS) - 1
WINDOW, LEAST, GENERALISE, REMOVE = 5, 10, 0.5, 0.9
#: Terms that a task counts before it passes them on.
HELD = 200_000
#: Terms that the driver and the tasks hold; more stay in a table that texts are joined with.
TERMS = 200_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them, but from each @ outwards: in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end, 0
        at = text.find("@", max(at + 1, end))


def entities(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its test are dropped without another try."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return found


def near(text: str, found: list[Span]) -> set[tuple[int, int, int, str]]:
    """(start, end, kind, term) of the words among the WINDOW before and the WINDOW after an entity of the kind; words that entities cover aren't terms."""
    words = [m.span() for m in _TERM.finditer(text)] if found else []
    starts, ends, covered = [a for a, _ in words], [b for _, b in words], Covered(found)
    out = set()
    for a, b, kind in found:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        for x, y in words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]:
            if not covered.meets(x, y):
                out.add((x, y, kind, text[x:y].lower()))
    return out


def shares(docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """(kind, term, share): share of the kind's information, for the terms from GENERALISE on; None without any. Two passes over all texts."""
    own = docs.select(F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("kind", pa.int32()), ("term", pa.string()), ("n", pa.int64())])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows() -> dict:
            return {"kind": [k for k, _ in counts], "term": [t for _, t in counts], "n": list(counts.values())}

        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                if found := entities(text := x.as_py() or ""):
                    counts.update((k, term) for _, _, k, term in near(text, found))
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    counts = cut(mapped(own, beside, "kind int, term string, n long", schema).groupBy("kind", "term").agg(F.sum("n").alias("n")))
    positions = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    chosen = counts.filter(F.col("n") >= LEAST)
    if not chosen.limit(1).count():
        return None

    def over_all(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows() -> dict:
            return {"kind": [0] * len(counts), "term": list(counts), "n": list(counts.values())}

        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                terms = _TERM.findall((x.as_py() or "").lower())
                counts[""] += len(terms)
                counts.update(terms)
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    totals = cut(mapped(own, over_all, "kind int, term string, n long", schema).groupBy("term").agg(F.sum("n").alias("total")))
    words = totals.filter("term = ''").first().total
    information = {k: -float(np.log(n / words)) for k, n in positions.items() if n < words}
    if not information:
        return None
    of_kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(x)) for k, x in information.items()))
    share = F.log(F.col("n") / F.greatest("n", F.coalesce("total", F.lit(0)))) / of_kind + 1
    found = cut(chosen.join(totals, "term", "left").select("kind", "term", share.alias("share")).filter(F.col("share") >= GENERALISE))
    return found if found.limit(1).count() else None


Terms = dict[tuple[int, str], float]


def disclosing(docs: DataFrame, text_col: str = "text") -> Terms:
    """shares() as a dictionary, for small tables."""
    found = shares(docs, text_col)
    return {} if found is None else {(r.kind, r.term): r.share for r in found.collect()}


def removed(terms: Terms) -> frozenset[str]:
    """The terms that are removed wherever they stand."""
    return frozenset(term for (_, term), share in terms.items() if share >= REMOVE)


def spans(text: str, terms: Terms, gone: frozenset[str]) -> tuple[list[Span], list[Span]]:
    """Base spans, and those of terms: GONE to remove, 4 + kind to generalise to it. gone: removed(terms)."""
    found = entities(text)
    extra: dict[tuple[int, int], tuple[float, int]] = {}
    if gone:
        covered = Covered(found)
        for m in _TERM.finditer(text):
            if m[0].lower() in gone and not covered.meets(*m.span()):
                extra[m.span()] = 1.0, 0
    if terms:
        for a, b, kind, term in near(text, found):
            if (share := terms.get((kind, term))) is not None:
                extra[a, b] = max((share, -kind), extra.get((a, b), (0.0, 0)))
    return found, [(a, b, GONE if share >= REMOVE else 4 - kind) for (a, b), (share, kind) in extra.items()]


def _with_terms(docs: DataFrame, text_col: str, name: str) -> tuple[DataFrame, Terms | None]:
    """docs with the column `name`, and the corpus's terms.

    Up to TERMS of them are a dictionary, and the column is null. More stay distributed: then there is no dictionary, and
    the column has what each text needs of it, by a join of the texts' distinct words with the terms.
    """
    kind = "array<struct<kind:int,term:string,share:double>>"
    found = shares(docs, text_col)
    if found is None or found.limit(TERMS + 1).count() <= TERMS:
        terms = {} if found is None else {(r.kind, r.term): r.share for r in found.collect()}
        return docs.withColumn(name, F.lit(None).cast(kind)), terms
    text = F.col(text_col).cast("string")
    own = docs.withColumn(f"{name}_text", F.md5(text))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for key, x in zip(batch.column(0), batch.column(1)):
                some = sorted(set(_TERM.findall((x.as_py() or "").lower())))
                yield {"key": [key.as_py()] * len(some), "term": some}

    each = mapped(own.select(F.col(f"{name}_text").alias("key"), text.alias("text")).filter("text IS NOT NULL"), words, "key string, term string", pa.schema([("key", pa.string()), ("term", pa.string())]))
    needed = each.distinct().join(found, "term").groupBy("key").agg(F.collect_list(F.struct("kind", "term", "share")).alias("_needed"))
    needed = needed.select(F.col("key").alias(f"{name}_key"), F.col("_needed").cast(kind).alias(name))
    return own.join(needed, F.col(f"{name}_text") == F.col(f"{name}_key"), "left").drop(f"{name}_key", f"{name}_text"), None


def _own(needed: list[dict] | None, terms: Terms | None, gone: frozenset[str]) -> tuple[Terms, frozenset[str]]:
    """The dictionary and its removed terms, or those that a row brings along."""
    if terms is not None:
        return terms, gone
    own = {(r["kind"], r["term"]): r["share"] for r in (needed if needed is not None else ())}
    return own, removed(own)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (base spans as text) and spans (all of them) of each row.

    Null and empty texts have no spans. Repeated rows and ids give a row each and count each; ids may be null. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType
    own, terms = _with_terms(own, "text", "_terms")
    gone = removed(terms or {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = (*KINDS, *[KINDS[4]] * 4)
        for batch in batches:
            counts, base, every = [[], [], [], []], [], []
            for x, needed in zip(batch.column(1), batch.column(2)):
                found, extra = spans(x.as_py() or "", *_own(needed.as_py(), terms, gone))
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in found))
                base.append(written(found, names))
                every.append(written(found + extra, names))
            yield {"doc_id": batch.column(0), **{f"n_{KINDS[k]}": counts[k] for k in range(4)}, "base": base, "spans": every}

    counted = ", ".join(f"n_{k} long" for k in KINDS[:4])
    types = pa.schema([("doc_id", to_arrow_type(kind)), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base", pa.string()), ("spans", pa.string())])
    return mapped(own.select("doc_id", "text", "_terms"), rows, f"doc_id {kind.simpleString()}, {counted}, base string, spans string", types)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with entities masked in the texts, and revealing terms generalised beside them or removed everywhere; the rest stays.

    Null texts stay null, empty ones empty; repeated rows and ids stay as they are and count each; an empty table gives
    no rows. Other columns stay, whatever their names but those that begin with _terms.
    """
    own, terms = _with_terms(docs, text_col, "_terms")
    gone = removed(terms or {})

    @F.pandas_udf("string")
    def clean(column: pd.Series, needed: pd.Series) -> pd.Series:
        def one(text: str | None, row: list[dict] | None) -> str | None:
            if not text:
                return text
            found, extra = spans(text, *_own(row, terms, gone))
            return masked(text, found + extra, MASKS) if found or extra else text

        return pd.Series(map(one, column, needed), dtype=object)

    return own.withColumn(text_col, clean(F.col(text_col).cast("string"), F.col("_terms"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2("base", 256).alias("base_sha256"), "spans")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the query that SQL can say: how many base spans of each kind a text has."""
    return find(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS[:4]))


SQL = r"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || right(p, 4))::INT > 255)) = 0)) AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 14 AND 19
    AND list_sum(list_transform(range(length(d)), lambda k: CASE WHEN k % 2 = 0 THEN d[length(d) - k]::INT WHEN d[length(d) - k]::INT > 4 THEN 2 * d[length(d) - k]::INT - 9 ELSE 2 * d[length(d) - k]::INT END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
