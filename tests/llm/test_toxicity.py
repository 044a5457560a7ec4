import zlib

import numpy as np
import pytest

from lodestack.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("seed", range(5))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, terms = 300, 40

    def vector():
        idx = np.sort(rng.choice(terms, rng.integers(1, 8), replace=False))
        w = rng.random(len(idx)) + 0.1
        return idx, w / np.linalg.norm(w)

    vectors = [vector() for _ in range(n)]
    vectors[10:40] = [vectors[0]] * 30  # ties
    dense = np.zeros((n, terms))
    for k, (i, w) in enumerate(vectors):
        dense[k, i] = w
    index = tx.BlockMaxIndex(vectors, terms, 16)
    for _ in range(50):
        idx, w = vector()
        query = np.zeros(terms)
        query[idx] = w
        cosine = np.round(dense @ query, 9)
        want = [k for k in np.lexsort((np.arange(n), -cosine))[:12] if cosine[k] > 0]
        best, got = index.nearest(idx, w, 12)
        assert best.tolist() == want and np.allclose(got, cosine[want])


def test_block_max_skips_blocks():
    vectors = [(np.array([t]), np.array([1.0])) for t in range(20) for _ in range(16)]
    index, seen = tx.BlockMaxIndex(vectors, 20, 16), []
    plain = index._scores
    index._scores = lambda i, w, blocks, out: (seen.extend(blocks.tolist()), plain(i, w, blocks, out))
    w = np.array([0.9, 0.1])
    index.nearest(np.array([3, 4]), w / np.linalg.norm(w), 5)
    assert seen == [3]


def test_held_out_quality(spark):
    rows = tx.op2_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert not set(r.evidence_ids) & {r.doc_id for r in rows if r.held_out} if r.doc_id < 50 else True
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = [p for p, y in held if y]
    flagged = [y for p, y in held if p]
    assert np.mean(caught) > 0.85 and np.mean(flagged) > 0.9
    assert np.mean([p == y for p, y in held]) > 0.97


def test_small_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "awful trash"), (4, "word " * 30_000), (4, "word " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.01 for r in got)
    nothing = tx.learn(docs, labels.limit(0))
    assert {r.score for r in tx.score(docs, nothing).collect()} == {0.5}
    assert tx.score(docs.limit(0), model).count() == 0


def test_learns_a_word(spark):
    rows = [(i, ("calm words here trash now " if i % 3 == 0 else "calm words here and now ") + f"w{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    got = {r.doc_id: r for r in tx.score(spark.createDataFrame([(1000, "such trash"), (1001, "such calm")], "doc_id long, text string"), model).collect()}
    assert got[1000].score > 0.9 > 0.1 > got[1001].score
    assert all(i % 3 == 0 for i in got[1000].evidence_ids)


def test_scores_and_evidence_of_a_dense_search(spark):
    """Every document of sf0.001 against plain code: all terms of the examples, frequencies over all documents, whole dense cosines."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    chosen = labels.where(tx.crc32_mod5(F.col("doc_id")) != 0)
    model = tx.learn(docs, chosen)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in chosen.collect() if r.doc_id in texts}
    tokens = {d: Counter(tx.WORD.findall(t.lower())) for d, t in texts.items()}

    def terms(words):
        out = Counter()
        for w, n in words.items():
            for t in tx.terms_of(w):
                out[t] += n
        return out

    known = {t for d in toxic for t in terms(tokens[d])}
    df = Counter(t for d in texts for t in terms(tokens[d]) if t in known)
    idf = lambda t: math.log((1 + len(texts)) / (1 + df[t])) ** 2

    def unit(d):
        out = {t: n * idf(t) for t, n in terms(tokens[d]).items() if t in known}
        lost = sum((n * idf("no such term")) ** 2 for w, n in tokens[d].items() if w not in known)
        length = math.sqrt(sum(x * x for x in out.values()) + lost)
        return {t: x / length for t, x in out.items()} if length else {}

    own = model.examples.value
    examples = {int(i): unit(int(i)) for i in own.ids}
    assert sorted(examples) == sorted(toxic) and {int(i): int(y) for i, y in zip(own.ids, own.labels, strict=True)} == toxic
    prior = [0.05 * sum(y == c for y in toxic.values()) / len(toxic) for c in (0, 1)]
    for r in tx.score(docs, model, evidence=5).collect():
        q = unit(r.doc_id)
        near = sorted(((-round(sum(x * e.get(t, 0.0) for t, x in q.items()), 9), n, int(i)) for n, (i, e) in enumerate((i, examples[int(i)]) for i in own.ids)))
        near = [(-c, i) for c, _, i in near if c < 0][:100]
        votes = [sum(c for c, i in near if toxic[i] == y) for y in (0, 1)]
        x = math.log(votes[1] + prior[1]) - math.log(votes[0] + prior[0])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.offset))), abs=1e-6)
        assert np.allclose(r.evidence_cosines, [c for c, _ in near[:5]], atol=1e-8)
        if len({c for c, _ in near[:6]}) == len(near[:6]):
            assert r.evidence_ids == [i for _, i in near[:5]]


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, "such trash" if i % 2 else "calm words", 0.5, 7) for i in range(40)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, toxic int, text string")
    assert {r.doc_id: r.score > 0.5 for r in tx.score(docs, tx.learn(docs, labels)).collect()} == {i: bool(i % 2) for i in range(40)}


def test_clusters_keep_texts_of_other_words_unread():
    """Two vocabularies, mixed in order: a text of one reads no block of the other, and what it finds is what plain products find."""
    rng = np.random.default_rng(1)
    n, terms = 1024, 600

    def counts(half, some):
        idx = half * 300 + rng.choice(300, some, replace=False, p=(p := 1 / np.arange(1, 301)) / p.sum())
        return idx, rng.choice([1.0, 1.0, 1.0, 2.0, 5.0, 300.0], some)

    vectors = [counts(k % 2, int(rng.integers(20, 60))) for k in range(n)]
    vectors[10:40:2] = [vectors[0]] * 15  # ties
    flat, sizes = np.concatenate([i for i, _ in vectors]), np.array([len(i) for i, _ in vectors])
    clusters = tx.clusters_of(flat, sizes, terms, clusters=2)
    assert len(set(clusters[::2])) == len(set(clusters[1::2])) == 1 and clusters[0] != clusters[1]
    lengths = np.array([np.linalg.norm(w) for _, w in vectors])
    index = tx.BlockMaxIndex(vectors, terms, 64, lengths, clusters)
    # the commonest terms are rows of their own section alone, others lists; few weights are kept at all
    assert [set((index.heavy[r] >= 300).tolist()) for r in index.rows] in ([{False}, {True}], [{True}, {False}])
    assert index.once.n.sum() and 0 < index.more.n.sum() < index.once.n.sum()
    seen, plain = set(), index._scores
    index._scores = lambda i, w, blocks, out: (seen.update(blocks.tolist()), plain(i, w, blocks, out))
    dense = np.zeros((n, terms))
    for k, (i, w) in enumerate(vectors):
        dense[k, i] = w / lengths[k]
    queries = [(i, w / np.linalg.norm(w)) for i, w in (counts(0, int(rng.integers(1, 60))) for _ in range(70))]
    queries.append((np.zeros(0, np.int64), np.zeros(0)))
    for (idx, w), k, (best, got) in zip(queries, [12, 700] * 40, index.nearest_each(queries, ([12, 700] * 40)[: len(queries)])):
        query = np.zeros(terms)
        query[idx] = w
        cosine = np.round(dense @ query, 9)
        want = [e for e in np.lexsort((np.arange(n), -cosine))[:k] if cosine[e] > 0]
        assert np.allclose(got, cosine[want], atol=2e-9) and (len(set(cosine[want])) < len(want) or best.tolist() == want)
    assert {clusters[e] for b in seen for e in index.number[b * 64 : b * 64 + 64] if e < n} == {clusters[0]}


def test_bags_of_texts_are_scored_as_the_texts(spark):
    texts = [None, "", "such trash", "calm words", "word " * 70_000 + "trash", "none of these", *(f"calm words here w{i} " + "trash " * (i % 2 * i) for i in range(60))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "such trash"), (2, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6, 66)], "doc_id long, toxic int")
    model, bags = tx.learn_bags(docs, labels)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    got = sorted(tx.score_bags(bags, model).collect(), key=key)
    assert len(got) == len(texts) + 2 and got == sorted(tx.score(docs, model).collect(), key=key)


@pytest.mark.parametrize("times", [[], [1.0], [1.0, 255.0], [1.0, 256.0, 70_000.0]])
def test_bags_are_read_as_written(times):
    ids = np.array([5, tx.SHORT + 7, tx.SHORT - 1], np.int32)[: len(times)]
    *bag, lost = tx.Bag.of(ids, np.array(times), np.array([2.0, 3.0]))
    got, n = tx.Bag.read(*bag)
    assert dict(zip(got.tolist(), n.tolist(), strict=True)) == dict(zip(ids.tolist(), times, strict=True)) and lost == 13


def test_query_takes_texts_apart_once(spark):
    """Scores come from the bags that were counted: the plan of the result reads no text."""
    plan = tx.op2_toxicity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "rare" in plan and "text" not in plan
