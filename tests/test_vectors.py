"""The tree of pivots: exact results, few visits on clustered vectors, and defined results at the edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.operators import retrieval


def frame(spark, m, key):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{key} long, vector array<double>")


def brute(queries, docs, k, threshold):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(queries) @ unit(docs).T
    return {(q, i + 1): int(d) for q, row in enumerate(scores)
            for i, d in enumerate([d for d in np.argsort(-row, kind="stable") if row[d] >= threshold][:k])}


@pytest.fixture(scope="module")
def clustered():
    """Twice the fan-out of clusters in 128 dimensions; one holds a third of all documents."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(48, 128))
    own = np.where(rng.random(6_000) < 1 / 3, 0, rng.integers(0, 48, 6_000))
    return centres[own] + rng.normal(0, 0.25, (6_000, 128)), centres[rng.integers(0, 48, 80)] + rng.normal(0, 0.25, (80, 128))


def test_clustered_vectors_visit_under_a_tenth_of_the_blocks(spark, clustered):
    docs, queries = clustered
    index = retrieval.vector_index(frame(spark, docs, "row"), 256)
    assert index.docs.count() == len(docs) and index.docs.groupBy("block").count().agg(F.max("count")).first()[0] <= 512
    visits = retrieval.block_visits(frame(spark, queries, "query_id"), index, 0.75).count()
    assert visits < 0.1 * len(queries) * index.blocks.count()


def test_clustered_vectors_give_the_exact_answer(spark, clustered):
    docs, queries = clustered
    got = retrieval.vector_retrieve(frame(spark, queries, "query_id"), frame(spark, docs, "row"), 7, 0.75, 256).collect()
    want = brute(queries, docs, 7, 0.75)
    assert len(want) > 400 and {(r.query_id, r["rank"]): r.row for r in got} == want


def test_equal_vectors_fill_several_blocks(spark):
    docs = np.tile([1.0, 0.0, 0.5], (500, 1))
    index = retrieval.vector_index(frame(spark, docs, "row"), 64)
    assert index.blocks.count() == 8
    got = retrieval.vector_retrieve(frame(spark, docs[:2], "query_id"), frame(spark, docs, "row"), 3, 0.75, 64).collect()
    assert sorted((r.query_id, r["rank"], r.row) for r in got) == [(q, i + 1, i) for q in range(2) for i in range(3)]


def test_no_documents_no_vectors_and_zero_vectors(spark):
    some = frame(spark, [[1.0, 0.0], None, [0.0, 0.0]], "query_id")
    none = frame(spark, [[1.0, 0.0]], "row").limit(0)
    assert retrieval.vector_retrieve(some, none).collect() == []
    docs = frame(spark, [[0.0, 0.0], None, [2.0, 0.0]], "row")
    got = retrieval.vector_retrieve(some, docs).collect()
    assert [(r.query_id, r["rank"], r.row, r.match_score) for r in got] == [(0, 1, 2, 100.0)]


def test_vectors_travel_once_a_pair_of_packs(spark, clustered, monkeypatch):
    docs, queries = clustered
    few, index = frame(spark, queries, "query_id"), retrieval.vector_index(frame(spark, docs, "row"), 256)
    packs = retrieval.query_packs(few, index, 0.2, 30)
    assert packs.count() <= 6 and sorted(i for r in packs.collect() for i in r.ids) == list(range(len(queries)))
    assert "vectors" not in retrieval.pack_visits(packs, index, 0.2).columns
    monkeypatch.setattr(retrieval, "PACK_BYTES", 30 * 8 * docs.shape[1])
    got = retrieval.vector_retrieve(few, frame(spark, docs, "row"), 7, 0.2, 256).collect()
    assert {(r.query_id, r["rank"]): r.row for r in got} == brute(queries, docs, 7, 0.2)
