"""BM25, fusion, nearest neighbours and the evidence gate on small cases with known answers."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions import vectors as V
from lodestack.operators import bm25, evidence, hybrid, knn
from lodestack.plans import retrieval


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(X.keyword_tokens(F.col("t")).alias("t")).first().t


def test_keyword_tokens(spark):
    found = tokens(spark, "The NIST Framework was published in 2023.")
    assert {"nist", "framework", "2023"} <= set(found) and not {"the", "was"} & set(found)
    assert "stratégie" in tokens(spark, "La stratégie nationale")
    assert tokens(spark, "人工智能")[:3] == ["人工", "工智", "智能"]
    assert "法" in tokens(spark, "法")
    assert tokens(spark, None) == tokens(spark, "") == []


def corpus(spark):
    rows = [(1, "Executive Order 14110 directs federal agencies on AI safety."), (2, "The weather is mild and sunny."), (3, "The order requires agencies to appoint chief AI officers."), (4, None)]
    return spark.createDataFrame([("s", i, t) for i, t in rows], "scope string, doc_id long, text string")


def test_bm25_ranks_exact_terms_first(spark):
    q = spark.createDataFrame([(0, "What does Executive Order 14110 require?"), (1, "")], "query_id long, text string")
    rows = bm25.top(bm25.scores(corpus(spark), q), 5).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in rows][0] == 1 and 2 not in {r.doc_id for r in rows} and {r.query_id for r in rows} == {0}
    assert bm25.scores(corpus(spark).limit(0), q).count() == 0


def test_bm25_by_hand(spark):
    docs = {1: "red apple apple", 2: "red pear", 3: "green plum fig nut"}
    c = spark.createDataFrame([("s", i, t) for i, t in docs.items()], "scope string, doc_id long, text string")
    q = spark.createDataFrame([(0, "apple red apple")], "query_id long, text string")
    avg = np.mean([3, 2, 4])
    def part(tf, df, dl):
        return np.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    got = {r.doc_id: r.bm25_score for r in bm25.scores(c, q).collect()}
    assert got == pytest.approx({1: part(2, 1, 3) + part(1, 2, 3), 2: part(1, 2, 2)})


@pytest.mark.parametrize("sent_rows", [bm25.SENT_ROWS, 1])
def test_bm25_tasks_are_as_many_as_their_pairs_need(spark, monkeypatch, sent_rows):
    c = spark.createDataFrame([("s", i, f"red apple w{i % 5}") for i in range(60)], "scope string, doc_id long, text string")
    q = spark.createDataFrame([(0, "red"), (1, "apple w1"), (2, "w2")], "query_id long, text string")
    want = {(r.query_id, r.doc_id): r.bm25_score for r in bm25.scores(c, q).collect()}
    monkeypatch.setattr(bm25, "PAIRS_PER_TASK", 10, raising=False)
    # 60 + 60 + 12 + 12 rows of query, document and term
    found = bm25.scores(c, q, sent_rows=sent_rows)
    assert found.rdd.getNumPartitions() == 15
    assert {(r.query_id, r.doc_id): r.bm25_score for r in found.collect()} == pytest.approx(want)


def test_fusion(spark):
    dense = spark.createDataFrame([(0, 1, 0.2, 1), (0, 2, 0.3, 2)], "query_id long, doc_id long, distance double, rank int")
    sparse = spark.createDataFrame([(0, 3, 9.0, 1), (0, 1, 5.0, 2), (7, 1, 5.0, 1)], "query_id long, doc_id long, bm25_score double, rank int")
    rows = hybrid.hybrid_candidates(dense, sparse, 10).orderBy("rank").collect()
    assert (rows[0].doc_id, rows[0].distance, rows[0].bm25_score) == (1, 0.2, 5.0)
    assert [r.doc_id for r in rows] == [1, 3, 2] and {r.query_id for r in rows} == {0}
    assert hybrid.rrf_merge(dense, sparse, 2).where("query_id = 0").count() == 2
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    filled = {r.doc_id: r.distance for r in hybrid.backfill_distances(hybrid.hybrid_candidates(dense, sparse, 10), queries, vectors).collect()}
    assert filled[3] == 1.0
    top = hybrid.rerank(hybrid.rrf_merge(dense, sparse, 10), F.col("doc_id").cast("double"), 1).where("query_id = 0").first()
    assert top.doc_id == 3 and hybrid.rerank(hybrid.rrf_merge(dense, sparse, 10), None, 1).where("query_id = 0").first().doc_id == 1
    assert hybrid.candidate_limit(6) == 20 and hybrid.candidate_limit(8) == 24


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(0)
    c = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(40, [0.0] * 5), (41, None), (42, [1.0, 2.0])]
    q = [(i, v) for i, v in c[:6]] + [(90, None)]
    cd = spark.createDataFrame(c, "doc_id long, vector array<double>")
    qd = spark.createDataFrame(q, "query_id long, vector array<double>")
    got = {}
    for r in knn.nearest(qd, cd, 4, block_rows=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    def distance(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 1 - (np.dot(a, b) / n if n else 0)
    want = {i: sorted((j for j, w in c if w and len(w) == 5), key=lambda j: (round(distance(v, c[j][1]), 9), j))[:4] for i, v in q if v}
    assert got == want


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_in_scope_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    # the 60 nearest of query 0 have another label
    c = [(i, "near", [1.0, 0.01 * rng.random()]) for i in range(60)] + [(60 + i, "far", rng.normal(size=2).tolist()) for i in range(9)] + [(70, None, [1.0, 0.0])]
    cd = spark.createDataFrame(c, "doc_id long, label string, vector array<double>")
    qd = spark.createDataFrame([(0, "far", [1.0, 0.0]), (1, "near", [1.0, 0.0]), (2, "none", [1.0, 0.0])], "query_id long, label string, vector array<double>")
    got = {}
    for r in knn.nearest(qd, cd, 5, block_rows=block, scope="label").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    distance = lambda v: round(1 - v[0] / np.linalg.norm(v), 9)
    want = {q: [i for _, i in sorted((distance(v), i) for i, s, v in c if s == label)[:5]] for q, label in ((0, "far"), (1, "near"))}
    assert got == want


def test_chunks_of_a_very_long_document_keep_their_key(spark, tmp_path):
    docs = [(1, "x" * 1_000_000 + "needle"), (2, "needle")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = retrieval.bm25_chunks(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.chunk_index, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1000, 1), (2, 0, 2)]
    assert found[0].bm25_score == found[1].bm25_score


def test_vector_expressions(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.d for r in df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [0.0, 1.0, 1.0]
    checks = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), ([1.0, None],), (None,), ([1.0, 2.0],)], "v array<double>")
    assert [r.ok for r in checks.select(V.valid_vector(F.col("v"), 2).alias("ok")).collect()] == [False, False, False, False, True]
    assert df.select(V.vector_literal(F.col("b")).alias("l")).first().l == "[2.00000000,0.00000000]"


def test_vector_literal_rounds_exact_values(spark):
    # 2^-9 lies halfway between two literals; the next two are nearest to decimals that end in 5, from below and above
    values = [0.001953125, 0.005859375, 1.5e-8, 5e-9, -0.0, -1e-12, float("nan"), float("-inf"), 1e22, None]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>")
    want = "SELECT '[' || array_to_string(list_transform(v, lambda x: format('{:.8f}', x)), ',') || ']' FROM (VALUES (1, $1::DOUBLE[]), (2, []), (3, NULL)) t(i, v) ORDER BY i"
    want = [r[0] for r in duckdb.execute(want, [values]).fetchall()]
    assert [r.l for r in df.select(V.vector_literal(F.col("v")).alias("l")).collect()] == want
    assert want[0].startswith("[0.00195312,0.00585938,0.00000001,0.00000001,-0.00000000,")


def test_a_missing_text_has_no_reranker_score(spark):
    df = spark.createDataFrame([("what council", "a council"), ("what council", ""), ("what council", None)], "q string, t string")
    assert [r.s for r in df.select(retrieval.overlap_score(F.col("q"), F.col("t")).alias("s")).collect()] == [-2.0, -3.0, None]


QUESTION = "How much may an eligible council request?"


def gate(spark, question, chunks, context="x" * 300, has=True, pages=None):
    q = spark.createDataFrame([(0, question, has)], "query_id long, question string, has_embeddings boolean")
    c = spark.createDataFrame([(0, k, t, d, s) for k, (t, d, s) in enumerate(chunks)], "query_id long, position int, text string, distance double, reranker_score double")
    ctx = spark.createDataFrame([(0, context)], "query_id long, context string")
    p = None if pages is None else spark.createDataFrame([(0, k, t) for k, t in enumerate(pages)], "query_id long, position int, text string")
    r = evidence.assess(q, c, ctx, p).first()
    return r.sufficient, r.reason


def test_evidence_gate(spark):
    assert gate(spark, QUESTION, [("text", 0.2, -2.0)]) == (True, None)
    assert gate(spark, QUESTION, [("text", 0.2, -3.0)]) == (False, evidence.LOW_RELEVANCE)
    assert gate(spark, QUESTION, [("An eligible council may request up to AUD 2 million.", 0.7, 1.0)])[0]
    assert gate(spark, QUESTION, [("Something else entirely.", 0.7, 1.0)]) == (False, evidence.LOW_RELEVANCE)
    assert gate(spark, QUESTION, []) == (False, evidence.LOW_RELEVANCE)
    assert gate(spark, QUESTION, [("text", 0.2, None)], context="short") == (False, evidence.SHORT_CONTEXT)
    ok, reason = gate(spark, "What does Australia's 2031 Quantum AI Act say?", [("General policy on AI in Australia.", 0.2, 1.0)])
    assert not ok and "Quantum AI Act" in reason
    assert gate(spark, QUESTION, [], context="", has=False, pages=["short"]) == (False, evidence.NO_TEXT)
    assert gate(spark, QUESTION, [], context="", has=False, pages=["p" * 250]) == (True, None)


def test_context_keeps_positions_and_cuts(spark):
    rows = [(0, 1, "a.md", 1, "one"), (0, 2, "a.md", None, " "), (0, 3, "b.md", 2, "y" * 100)]
    df = spark.createDataFrame(rows, "query_id long, position int, file string, page int, text string")
    r = evidence.context(df, 50).first()
    assert r.context.startswith("[1] a.md, page 1\none\n\n---\n\n[3] b.md, page 2\ny") and r.truncated and r.n_citations == 2
    assert len(r.context) == 50 + len("\n\n---\n\n")


def test_question_validation(spark):
    c = spark.createDataFrame([(0, 1, "Q good1"), (0, 2, "Q bad"), (0, 3, "Q good2"), (0, 4, "Q good3")], "group_id long, position int, question string")
    d = spark.createDataFrame([(0, 1, 0.2), (0, 2, 1.0), (0, 3, 0.3), (0, 4, 0.25)], "group_id long, position int, distance double")
    assert [r.question for r in evidence.validate_questions(c, d, 0.45, 2).orderBy("kept").collect()] == ["Q good1", "Q good2"]


def test_web_gate_fails_closed(spark):
    rows = [(0, "u1", 0, "far", 0.6, 2.0), (0, "u1", 1, "near", 0.1, None), (0, "u2", 0, "near", 0.1, 2.0)]
    df = spark.createDataFrame(rows, "query_id long, url string, ordinal int, text string, distance double, reranker_score double")
    assert {(r.url, r.text, r.passed) for r in evidence.web_gate(df, 0.45, 0.5).collect()} == {("u1", "near", False), ("u2", "near", True)}
    assert all(r.passed for r in evidence.web_gate(df, 0.45).collect())


def test_runs_of_cjk_are_found_beside_any_other_character(spark):
    from pyspark.sql import functions as F

    from lodestack.functions.text import keyword_tokens

    given = {"plain words": ["plain", "words"], "é ü": ["é", "ü"], "a\u3040\u30ffb": ["\u3040\u30ff", "b"], "x\u3400": ["\u3400", "x"], "\uf900\ufaff y": ["\uf900\ufaff", "y"], "\uac00 \U00020000": ["\uac00", "\U00020000"], "": [], None: []}
    rows = spark.createDataFrame([(k,) for k in given], "text string").select("text", keyword_tokens(F.col("text")).alias("t")).collect()
    # a lone letter a is a glue word
    assert {r.text: r.t for r in rows} == given
