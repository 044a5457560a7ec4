"""Neighbours with skipping against brute force, and how much is skipped."""

import numpy as np
import pytest

from lodestack.operators import knn
from lodestack.operators.pivots import PivotIndex


def frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, vector array<double>")


def clustered(rng, n, dims=8, centres=12):
    middle = rng.normal(size=(centres, dims))
    return [(i, middle[i % centres] + 0.05 * rng.normal(size=dims)) for i in range(n)]


def plain(queries, corpus):
    def distance(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 1 - (float(np.dot(a, b)) / n if n else 0.0)

    return {q: sorted((round(distance(v, w), 9), i) for i, w in corpus if w is not None and len(w) == len(v)) for q, v in queries if v is not None and len(v)}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((pytest.approx(r.distance, abs=1e-9), r.doc_id))
    return out


@pytest.mark.parametrize("k", [1, 5, 700])
def test_nearest_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    odd = [(9000, [0.0] * 8), (9001, None), (9002, []), (9003, [1.0, 2.0]), (9004, [0.0] * 8), (9005, [0.0, 0.0])]
    same = [(8000 + i, [1.0] * 8) for i in range(40)]
    corpus = clustered(rng, 500) + same + odd
    queries = [(i, rng.normal(size=8)) for i in range(20)] + corpus[:10] + same[:1] + odd
    queries = [(100 + n, v) for n, (_, v) in enumerate(queries)]
    index = PivotIndex(frame(spark, corpus, "doc_id"), n_pivots=6, block_rows=32)
    want = {q: rows[:k] for q, rows in plain(queries, corpus).items() if rows}
    assert got(index.nearest(frame(spark, queries, "query_id"), k)) == want


def test_most_blocks_are_skipped_where_vectors_cluster(spark):
    rng = np.random.default_rng(3)
    corpus = clustered(rng, 3000)
    queries = corpus[:60]
    index = PivotIndex(frame(spark, corpus, "doc_id"), n_pivots=40, block_rows=32)
    found = index.nearest(frame(spark, queries, "query_id"), 5)
    assert got(found) == {q: rows[:5] for q, rows in plain(queries, corpus).items()}
    pairs = sum(p.count() for p in index.read)
    everything = index._asked(frame(spark, queries, "query_id"), 5)[0].count() * index.blocks.count()
    assert pairs < 0.3 * everything
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("limit", [0.0, 0.05, 1.0, 2.0])
def test_within_equals_brute_force(spark, limit):
    rng = np.random.default_rng(4)
    corpus = clustered(rng, 200) + [(900, [0.0] * 8), (901, None)]
    queries = [(i, v) for i, v in corpus if i % 4 == 0]
    index = PivotIndex(frame(spark, corpus, "doc_id"), n_pivots=10, block_rows=16)
    rows = {(r.query_id, r.doc_id) for r in index.within(frame(spark, queries, "query_id"), limit).collect()}
    # distances on the very limit aren't judged
    sure = {(q, i) for q, near in plain(queries, corpus).items() for d, i in near if d < limit - 1e-8}
    assert sure <= rows <= {(q, i) for q, near in plain(queries, corpus).items() for d, i in near if d <= limit + 1e-8}


def test_blocks_are_sent_once_to_a_tile_and_not_once_for_each_block_they_meet(spark):
    rng = np.random.default_rng(7)
    corpus = [(i, rng.normal(size=8)) for i in range(2000)]
    index = PivotIndex(frame(spark, corpus, "doc_id"), n_pivots=8, block_rows=16)
    index.within(frame(spark, corpus, "query_id"), 0.5)
    blocks, pairs = index.blocks.count(), index.read[0].count()
    assert blocks >= 125 and pairs > 40 * blocks
    assert index.tiles.count() <= 2 * 8 * blocks


@pytest.mark.parametrize("tile_bytes", [2048, 1 << 20])
def test_the_nearest_within_a_distance_are_ranked_over_all_tiles(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr("lodestack.operators.pivots.TILE_BYTES", tile_bytes)
    rng = np.random.default_rng(8)
    corpus = clustered(rng, 200) + [(1000 + i, [1.0] * 8) for i in range(60)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0])]
    index = PivotIndex(frame(spark, corpus, "doc_id"), n_pivots=5, block_rows=8)
    rows = index.within(frame(spark, corpus, "query_id"), 0.05, 3).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((round(r.distance, 9), r.doc_id))
    assert {q: sorted(v) for q, v in found.items()} == {q: near for q, rows in plain(corpus, corpus).items() if (near := [x for x in rows if x[0] <= 0.05][:3])}


def test_empty_sides(spark):
    some, none = clustered(np.random.default_rng(5), 5), []
    assert PivotIndex(frame(spark, none, "doc_id")).nearest(frame(spark, some, "query_id"), 3).collect() == []
    assert PivotIndex(frame(spark, some, "doc_id")).nearest(frame(spark, none, "query_id"), 3).collect() == []
    assert PivotIndex(frame(spark, some, "doc_id")).within(frame(spark, none, "query_id"), 3).collect() == []


def test_agrees_with_blocks_against_blocks(spark):
    rng = np.random.default_rng(6)
    corpus, queries = clustered(rng, 300), clustered(rng, 7)
    a = PivotIndex(frame(spark, corpus, "doc_id")).nearest(frame(spark, queries, "query_id"), 9)
    assert got(a) == got(knn.nearest(frame(spark, queries, "query_id"), frame(spark, corpus, "doc_id"), 9))
