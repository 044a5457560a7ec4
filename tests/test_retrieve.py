"""Scoped hybrid retrieval against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import bm25, facets, hybrid, retrieve, scopes
from tests.test_filters import DOCS, FILTERS, plain_matches


def plain_bm25(texts, members, question):
    docs = {i: (texts[i] or "").split() for i in members if i in texts}
    if not docs:
        return {}
    n, avg, out = len(docs), sum(map(len, docs.values())) / len(docs), {}
    for term in set(question.split()):
        df = sum(term in words for words in docs.values())
        for i, words in docs.items():
            tf = words.count(term)
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
    return {i: s for i, s in out.items() if s > 0}


def plain_retrieve(texts, vectors, members, question, vector, k, score):
    limit = max(3 * k, 20)
    distance = lambda v: 1 - float(np.dot(v, vector) / (np.linalg.norm(v) * np.linalg.norm(vector)))
    dense = sorted((i for i in members if i in vectors), key=lambda i: (round(distance(vectors[i]), 9), i))[:limit]
    if not dense:
        return []
    found = plain_bm25(texts, members, question)
    sparse = sorted(found, key=lambda i: (-round(found[i], 9), i))[:limit]
    order = dense + [i for i in sparse if i not in dense]
    rrf = {i: (1 / (60 + dense.index(i) + 1) if i in dense else 0) + (1 / (60 + sparse.index(i) + 1) if i in sparse else 0) for i in order}
    fused = sorted(order, key=lambda i: (-round(rrf[i], 12), order.index(i)))[:limit]
    return sorted(fused, key=lambda i: (-score(question, texts.get(i) or ""), fused.index(i)))[:k]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    # ids on both sides of a bitmap's row, and 0
    ids = [*range(0, 120), *range(32_760, 32_780), 100_000]
    docs = [(i, rng.sample(["A", "B", "C"], rng.randrange(3)), rng.choice(["X", "Y", None]), "o", rng.choice(["en", "fr"]), rng.sample(["t", "u"], rng.randrange(3)), rng.choice([None, 2000, 2010])) for i in ids]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(1, 40))) for i in ids if i % 11}
    texts.update({i: None for i in ids if i % 22 == 0})
    vectors = {i: np.array([rng.gauss(0, 1) for _ in range(4)]) for i in ids if i % 5}
    asked = [(q, " ".join(rng.choices(words, k=3)), rng.choice([([], [], [], [], [], None, None), (["a"], [], [], [], [], None, None), ([], ["x"], [], ["EN"], [], None, None), ([], ["x"], [], ["en"], [], None, None), ([], [], [], [], ["t", "U"], 2005, None), (["zzz"], [], [], [], [], None, None)])) for q in range(24)]
    queries = {q: np.array([rng.gauss(0, 1) for _ in range(4)]) for q, _, _ in asked if q != 3}
    return docs, texts, vectors, asked, queries


def frames(spark, world):
    docs, texts, vectors, asked, queries = world
    wanted = spark.createDataFrame([(q, *f, False) for q, _, f in asked], FILTERS)
    return (
        spark.createDataFrame([(q, t) for q, t, _ in asked], "query_id long, question string"),
        spark.createDataFrame([(q, v.tolist()) for q, v in queries.items()], "query_id long, vector array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "doc_id long, vector array<double>"),
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        scopes.Scopes(wanted, facets.FacetIndex(spark.createDataFrame(docs, DOCS))),
    )


def members_of(world, f):
    hit = [d[0] for d in world[0] if plain_matches(d, (0, *f, False))]
    return hit or [d[0] for d in world[0]]


def test_statistics_and_scores_are_the_scopes_own(spark, world):
    _, texts, _, asked, _ = world
    questions, _, _, corpus, own = frames(spark, world)
    found = bm25.postings(corpus.select(F.lit("").alias("scope"), "doc_id", "text"), bm25.query_terms(questions.withColumnRenamed("question", "text")))
    of = {r.query_id: r.scope for r in own.of_query.collect()}
    # filters that differ in case alone share a scope; those that leave nothing, or ask for nothing, share all documents
    assert len(set(of.values())) <= 4 and of[next(q for q, _, f in asked if f[0] == ["zzz"])] == scopes.ALL
    stats = {r.scope: (r.n_docs, r.avgdl) for r in scopes.statistics(found.where("term is null").select("doc_id", "dl"), own.bits).collect()}
    got = {}
    for r in scopes.scores(found, bm25.query_terms(questions.withColumnRenamed("question", "text")), own).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.bm25_score
    for q, question, f in asked:
        members = [i for i in members_of(world, f) if i in texts]
        assert stats[of[q]] == (len(members), pytest.approx(sum(len((texts[i] or "").split()) for i in members) / len(members)))
        assert got.get(q, {}) == pytest.approx(plain_bm25(texts, members_of(world, f), question))


@pytest.mark.parametrize("scored", [True, False])
def test_retrieve_equals_plain_code(spark, world, scored):
    _, texts, vectors, asked, queries = world
    questions, vecs, corpus, docs, own = frames(spark, world)
    score = (lambda question, text: F.length(F.coalesce(text, F.lit(""))).cast("double") % 7) if scored else None
    rows = retrieve.retrieve(questions, vecs, corpus, docs, own, 7, score).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.new_rank):
        got.setdefault(r.query_id, []).append(r.doc_id)
        assert r.distance == pytest.approx(1.0 if r.doc_id not in vectors else 1 - float(np.dot(vectors[r.doc_id], queries[r.query_id]) / (np.linalg.norm(vectors[r.doc_id]) * np.linalg.norm(queries[r.query_id]))))
    plain = lambda question, text: len(text) % 7 if scored else 0
    assert got == {q: plain_retrieve(texts, vectors, members_of(world, f), question, queries[q], 7, plain) for q, question, f in asked if q in queries}


def test_vectors_alone(spark, world):
    _, _, vectors, asked, queries = world
    questions, vecs, corpus, docs, own = frames(spark, world)
    rows = retrieve.retrieve(questions, vecs, corpus, docs, own, 3, keywords=False).collect()
    assert {r.query_id for r in rows} == set(queries) and all(r.bm25_score is None for r in rows)
    assert hybrid.candidate_limit(3) == 20


def test_membership_of_bitmaps(spark):
    ids = [0, 1, 7, 8, 9, 32_768, 32_769, 65_537, 1 << 40]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    bits = scopes.bitmaps(rows)
    probe = spark.createDataFrame([(i,) for i in [*ids, 2, 10, 32_767, (1 << 40) + 1]], "doc_id long").withColumn("bucket", F.bitmap_bucket_number("doc_id"))
    assert sorted(r.doc_id for r in probe.join(bits, "bucket").where(scopes.has(F.col("bits"), F.col("doc_id"))).collect()) == ids


def test_pieces_of_bitmaps_have_what_the_bitmaps_have(spark):
    ids = [0, 7, 8, 1023, 1024, 32767, 32768, 40000, 65535, 70001]
    bits = scopes.bitmaps(spark.createDataFrame([("a", i) for i in ids] + [("b", 8)], "scope string, doc_id long"), "scope")
    cut = scopes.pieces(bits)
    assert {r[0] for r in cut.select(F.length("bits")).collect()} == {scopes.PIECE // 8} and cut.where("scope = 'b'").count() == 1
    probe = spark.range(0, 100_000).select(F.col("id").alias("doc_id"), F.bitmap_bucket_number("id").alias("bucket"), scopes.piece_of(F.col("id")).alias("piece"))
    found = probe.join(cut.where("scope = 'a'"), ["bucket", "piece"]).where(scopes.has(F.col("bits"), F.col("doc_id"), scopes.PIECE))
    assert sorted(r.doc_id for r in found.collect()) == ids


def test_filters_are_sent_to_the_postings_and_not_the_other_way(spark):
    from lodestack.operators import facets

    docs = spark.createDataFrame([(i, ["asia"], "NATION", "web", "en", ["en"], 2000 + i % 20) for i in range(50)], "doc_id long, policy_areas array<string>, country_region string, source_organisation string, language string, keywords array<string>, year int")
    empty = F.array().cast("array<string>")
    filters = spark.range(3).select(F.col("id").alias("query_id"), *[(F.array(F.lit("EN")) if d == "languages" else empty).alias(d) for d in facets.DIMENSIONS], F.lit(2005).alias("year_from"), F.lit(None).cast("int").alias("year_to"))
    found = facets.hits(filters, facets.FacetIndex(docs))
    lines, sent = found._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = iter(lines[i + 1 :])
            while (x := next(below, None)) is not None and len(x) - len(x.lstrip(" :+-")) > depth - 1:
                sent.append(x)
    assert any("facet-rarest" in x for x in sent) and not any("facet-postings" in x for x in sent)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(q, i) for q in range(3) for i in range(50) if i % 20 >= 5}
