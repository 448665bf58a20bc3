"""Stages of the pipeline against what they promise, each on the output of the one before it, and the entry's contract."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from syndilake.llm import pii

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(to / str(k)))
        docs = spark.read.parquet(str(to / str(k)))
        out.append(docs)
    return out


def test_columns_and_decisions(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["toxicity", "simhash", "pii", "mixing", "byte-level"]
    for frame in stages[1:-1]:
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    texts = [{r.doc_id: r.text for r in frame.select("doc_id", "text").collect()} for frame in stages[:-1]]
    assert texts[1].keys() <= texts[0].keys() and texts[2].keys() <= texts[1].keys()
    assert len(set(texts[2].values())) == len(texts[2])
    assert texts[3].keys() == texts[2].keys()
    assert not any(pii.entities(t) for t in texts[3].values())
    assert all(texts[3][k] == t for k, t in texts[2].items() if not pii.entities(t))
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert copies.keys() <= texts[3].keys() and set(copies.values()) <= {1, 2}
    done = stages[5].collect()
    assert Counter(r.doc_id for r in done) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(texts[3][r.doc_id].encode()).hexdigest() for r in done)


def test_run_gives_the_last_stage(spark, stages):
    ran = Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert ran == Counter(map(tuple, stages[-1].collect()))


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names
