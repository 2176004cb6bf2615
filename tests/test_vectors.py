"""Exact neighbours by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import vectors


def rows(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def plain(q, r, k, own=False):
    sims = np.round(q @ r.T, 9)
    out = set()
    for i, row in enumerate(sims):
        order = [j for j in sorted(range(len(r)), key=lambda j: (-row[j], j)) if not (own and i == j)][:k]
        out |= {(i, j, n + 1) for n, j in enumerate(order)}
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_cells_are_exact(spark, monkeypatch, unit):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "PER_PIVOT", 25)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    r = np.vstack([centres[i % 6] + rng.normal(0, 0.1, 8) for i in range(300)] + [centres[0]] * 30)
    q = np.vstack([centres[i % 6] + rng.normal(0, 0.3, 8) for i in range(50)] + [rng.normal(size=(10, 8))])
    if unit:
        r, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r, q))
    got = {(x.query_id, x.ref_id, x["rank"]) for x in vectors.knn(rows(spark, q), rows(spark, r), 7).collect()}
    assert got == plain(q, r, 7)
    own = {(x.query_id, x.ref_id, x["rank"]) for x in vectors.knn(rows(spark, r), rows(spark, r), 5, exclude_self=True).collect()}
    assert own == plain(r, r, 5, own=True)


def test_clustered_vectors_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_PIVOT", 8)
    rng = np.random.default_rng(5)
    centres = np.eye(16)
    r = np.vstack([centres[i % 16] + rng.normal(0, 0.01, 16) for i in range(800)])
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    named = rows(spark, r).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    refs, asked, pivots = vectors._cells(named, named, 800)
    first = vectors._measure(refs, asked.select("id", "v", F.col("order")[0].alias("cell")), 3, False, "query_id long, ref_id long, sim double")
    bound = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("sim").alias("_sim"))
    visits = vectors.visited(asked, bound, 3).groupBy("id").count().agg(F.avg("count")).first()[0]
    assert pivots == 100 and visits < 20


def _plain_top(own, queries, ids, matrix, k, exclude_self):
    sims = np.round(np.array(queries) @ matrix.T, 9)
    out = []
    for q, row in zip(own.tolist(), sims.tolist(), strict=True):
        ranked = sorted((-s, i) for s, i in zip(row, ids.tolist(), strict=True) if not (exclude_self and i == q))
        out += [(q, i, -s) for s, i in ranked[:k]]
    return out


def test_top_is_taken_few_products_at_a_time(monkeypatch):
    """The most similar with their ties by id, without a table of all products in order."""
    rng = np.random.default_rng(5)
    matrix = rng.integers(-2, 3, (200, 4)) / 4
    ids, own = rng.permutation(200), np.arange(90)
    queries = (rng.integers(-2, 3, (90, 4)) / 4).tolist()
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *r, **k: (sizes.append(a.size), partition(a, *r, **k))[1])
    monkeypatch.setattr(vectors, "PRODUCTS", 2000)
    for k, alone in ((5, True), (5, False), (500, True)):
        got = vectors._top(own, queries, ids, matrix, k, alone)
        assert list(zip(got["query_id"], got["ref_id"], got["sim"], strict=True)) == _plain_top(own, queries, ids, matrix, k, alone)
    assert sizes and max(sizes) <= 2000
    assert len(vectors._top(own[:0], [], ids, matrix, 5, True)) == len(vectors._top(own, queries, ids[:0], matrix[:0], 5, True)) == 0


def test_vectors_without_clusters_meet_by_blocks(spark, monkeypatch):
    """Where bounds rule out little, pairs of blocks give what one block gives, and no query is sent to every cell."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 16)))]
    df = spark.createDataFrame([(i, [x / float(np.linalg.norm(v)) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = {(r.query_id, r.ref_id, r.rank) for r in vectors.knn(df, df, 4, exclude_self=True).collect()}
    used, by_blocks = [], vectors._by_blocks
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "PER_PIVOT", 10)
    monkeypatch.setattr(vectors, "_by_blocks", lambda *a: (used.append(1), by_blocks(*a))[1])
    assert {(r.query_id, r.ref_id, r.rank) for r in vectors.knn(df, df, 4, exclude_self=True).collect()} == want and used
