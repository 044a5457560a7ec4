import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import exact_dedup, mixing, simhash

SCHEMA = "doc_id long, text string, source string, lang string, digest string, fp long, size long, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", 7, None, "clash") for i, t, s in rows], SCHEMA)


ROWS = [(5, "a b c d", "s1"), (9, "a b c d", "s1"), (1, None, None), (2, "", "s2"), (3, "A  b\tc d", "s2"), (None, "q", "s1"), (7, "long " * 5000, None), (4, "   ", "s2"), (7, "long " * 5000, None)]


def test_exact_dedup_keeps_largest_id_and_handles_nulls(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs_of(spark, ROWS)).collect()}
    assert got == {(5, 9, 2, False), (9, 9, 2, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (None, None, 1, True), (7, 7, 2, True), (4, 4, 1, True)}
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_index_persists_between_batches(spark):
    index = exact_dedup.DigestIndex(spark, n_buckets=3)
    first = docs_of(spark, [(1, "x", "s"), (2, "y", "s")])
    second = docs_of(spark, [(3, "x", "s"), (4, "z", "s"), (5, "z", "s")])
    index.deduplicate(first.select("doc_id", "text"))
    again = exact_dedup.DigestIndex(spark, index.name, index.path, 3)
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.deduplicate(second.select("doc_id", "text")).collect()} == {(3, 1, False), (4, 5, False), (5, 5, True)}
    assert again.table().count() == 3
    plan = index.unseen(spark.createDataFrame([("d", 1)], "digest string, keep_id long"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_documents_keep_their_columns(spark):
    docs = docs_of(spark, ROWS)
    for kept in (exact_dedup.keep_distinct_texts(docs), simhash.one_of_each_group(docs), mixing.mixed_documents(docs)):
        assert kept.columns == docs.columns
        kept.collect()
    assert {r.doc_id for r in exact_dedup.keep_distinct_texts(docs).collect()} == {9, 2, 3, None, 7, 4}


def test_repeated_and_missing_ids_keep_one_row(spark):
    rows = [(1, "a")] * 3 + [(2, "a")] * 2 + [(None, "b")] * 4 + [(0, "c"), (0, "c"), (0, "d"), (None, "c"), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = exact_dedup.keep_distinct_texts(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert found == [("0", "c"), ("0", "d"), ("2", "a"), ("7", ""), ("None", "b")]


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b c", "a b c d e " * 40, "É é\x0b\x0c x y Z z", "x " * 3])
def test_fingerprint_matches_its_definition(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % 2**64 == plain_fingerprint(text)


def brute_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin((fps[i] ^ fps[j]) % 2**64).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("crowded", [100, 1])
def test_links_find_every_pair_within_three_bits(spark, crowded):
    import random

    rng = random.Random(5)
    fps = {}
    for i in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps[len(fps)] = x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(v, k) for k, v in fps.items()], "fp long, rep long")
    edges = simhash.links(table.groupBy("fp").agg(F.min("rep").alias("rep")), crowded=crowded)
    distinct = {}
    for k, v in sorted(fps.items()):
        distinct.setdefault(v, k)
    want = brute_components({k: v for v, k in distinct.items()})
    got = dict.fromkeys(want)
    got.update({r.node: r.component for r in simhash.connected_components(edges, "t").collect()})
    assert {k: v if v is not None else k for k, v in got.items()} == want


def test_near_duplicates_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_components({r.doc_id: plain_fingerprint(r.text) for r in rows})
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert got == {r.doc_id: (plain_fingerprint(r.text), want[r.doc_id]) for r in rows}


def test_one_document_of_each_group_stays(spark):
    far = "quite another text with many words of its own"
    rows = [(1, "a b c"), (2, "a b c"), (2, far), (3, far), (None, far), (4, None), (5, ""), (6, " \t"), (7, "long words here " * 20_000), (8, "long words here " * 20_000), (1, "a  b c")]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    found = sorted((str(r.doc_id), r.text or "") for r in simhash.one_of_each_group(docs).collect())
    assert found == sorted([min(("1", "a b c"), ("1", "a  b c"), key=lambda r: hashlib.sha256(r[1].encode()).digest()), ("2", far), ("4", ""), ("7", "long words here " * 20_000), ("None", far)])
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    of = lambda t: plain_fingerprint(t) - (2**64 if plain_fingerprint(t) >= 2**63 else 0)
    assert got == {(1, of("a b c")): 1, (2, of("a b c")): 1, (2, of(far)): 2, (3, of(far)): 2, (None, of(far)): None, (4, 0): 4, (5, 0): 4, (6, 0): 4, (7, of("long words here " * 3)): 7, (8, of("long words here " * 3)): 7}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each_group(docs.limit(0)).count() == 0


def plain_targets(sizes):
    total, targets = sum(sizes.values()), {}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        free = [s for s in sizes if s not in targets]
        if not free:
            return targets
        level = (total - sum(targets.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return targets | {s: level * weight[s] for s in free}
        targets |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_plain_values(spark, seed):
    import random

    rng = random.Random(seed)
    sources = [None, "", *[f"s{k}" for k in range(9)]]
    share = [rng.random() ** 4 for _ in sources]
    rows = [(i, None if i % 11 == 0 else "w " * rng.randint(0, 30), rng.choices(sources, share)[0]) for i in range(300)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, run = plain_targets(dict(sizes)), defaultdict(int)
    got = {r.doc_id: r for r in mixing.mix(docs_of(spark, rows)).collect()}
    for i, t, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        size, budget, at = len((t or "").split()), round(want[s]), run[s]
        taken = sum(max(0, min(size, budget - at - e * sizes[s])) for e in range(3))
        assert (got[i].size, got[i].source_size, got[i].taken) == (size, sizes[s], taken)
        assert got[i].target == pytest.approx(want[s], abs=1e-5)
        run[s] += size


@pytest.mark.parametrize("n", [1, 512, 513, 3000])
def test_starts_are_running_sums(spark, n, monkeypatch):
    import random

    from lodestack.llm import common

    monkeypatch.setattr(common, "FAN_OUT", 16)
    rows = [(k, b, random.Random(b).randint(0, 9)) for k in ("a", None) for b in range(n) if b % 3]
    got = {(r.k, r.bucket): r.start for r in common.starts(spark.createDataFrame(rows, "k string, bucket long, n long"), ["k"], "n", n).collect()}
    run, want = defaultdict(int), {}
    for k, b, x in rows:
        want[k, b] = run[k]
        run[k] += x
    assert got == want


def test_mix_meets_targets_and_repeats_at_most_three_times(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == 0 or 0 <= r.position <= 1
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    for s, (t, size) in target.items():
        assert taken[s] == round(t) and t <= 3 * size + 1e-6
    assert abs(sum(t for t, _ in target.values()) - sum(r.size for r in rows)) < 1e-3


def test_mix_edge_cases(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)])).collect())
    rows = mixing.mix(docs_of(spark, ROWS)).collect()
    assert len(rows) == len(ROWS)
    assert mixing.mix(docs_of(spark, ROWS)).collect() == rows


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_positions_invert_the_integral(spark, knots):
    import numpy as np

    t = np.linspace(0, 1, 100001)
    r = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
    integral = np.concatenate([[0], np.cumsum((r[1:] + r[:-1]) / 2 * np.diff(t))])
    shares = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "q double")
    got = [r.t for r in df.select(mixing.inverted(knots, F.col("q")).alias("t")).collect()]
    want = np.interp(np.array(shares) * integral[-1], integral, t)
    assert np.allclose(got, want, atol=1e-4)


def test_sha_matches_hashlib(spark):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs_of(spark, [(1, "é", "s"), (2, None, "s")])).collect()}
    assert got == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
