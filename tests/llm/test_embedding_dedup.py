import numpy as np
import pytest

from lodestack.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, links string, component string"


def brute(rows, threshold):
    ok = [(i, np.array(v, np.float64), k) for i, v, k in rows if i is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    pairs = []
    for x in range(len(ok)):
        for y in range(x):
            (i, u, k), (j, w, m) = ok[x], ok[y]
            if k == m and len(u) == len(w) and u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return {(i, links[i], comp[i], comp[i] == i) for i, _, _ in rows}


def planted(seed, n_groups=30, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = rng.normal(size=dims)
        for c in range(rng.integers(1, 12)):
            v = base + rng.normal(size=dims) * rng.choice([0, 0.05, 0.25, 0.4])
            rows.append((len(rows), np.float32(v).tolist(), int(g % 3)))
    return rows


@pytest.mark.parametrize("sizes", [(2048, 256), (16, 4)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(ed, "INTERVAL_ROWS", sizes[0])
    monkeypatch.setattr(ed, "LEAF_ROWS", sizes[1])
    monkeypatch.setattr(ed.intervals, "__defaults__", (ed.AXES, sizes[0]))
    rows = planted(3)
    got = {tuple(r) for r in ed.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    assert got == brute(rows, ed.THRESHOLD)


def test_rows_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.1], 1), (12, [1e38, 0.0], 1), (13, [1e-40, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in [*rows, (None, [1.0, 0.0], 1)]], SCHEMA)
    got = {tuple(r) for r in ed.near_duplicates(df).collect()}
    want = {(i, n, c, k) for i, n, c, k in brute(rows, ed.THRESHOLD)}
    assert got == want | {(None, 0, None, True)}
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_copies(spark):
    rows = [(1, [1.0, 2.0], 0)] * 2 + [(7, [1.0, 2.0], 0), (9, [1.0, -2.0], 0)]
    got = sorted(tuple(r) for r in ed.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (7, 2, 1, False), (9, 0, 9, True)]


def test_a_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert {tuple(r) for r in ed.near_duplicates(df).collect()} == brute(rows, ed.THRESHOLD)


def test_a_repeated_id_joins_nothing(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (3, b, 0), (4, [-0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in ed.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False)]


def test_sql_leaves_odd_vectors_alone(spark, tmp_path):
    import duckdb

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [nan, 1.0], 1), (11, [1.0, 0.1], 1), (12, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "e"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert set(db.execute(ed.OP4_SQL).fetchall()) == {tuple(r) for r in ed.near_duplicates(df).collect()}
