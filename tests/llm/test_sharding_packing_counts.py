import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import bpe, packing, sharding, wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, "long words " * 9000, "y"), (3, "long words " * 9000, "y"), (4, "a b", "z")]
ODD_SCHEMA = "doc_id long, text string, slot string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=80), st.integers(2, 7))
def test_differencing_deals_every_item_and_stays_within_the_largest(sizes, k):
    parts = np.zeros((len(sizes), k), np.int64)
    parts[:, 0] = sizes
    shard = sharding.difference(parts)
    assert all(sorted(r) == list(range(k)) for r in shard.tolist())
    sums = np.bincount(shard[:, 0], weights=sizes, minlength=k) if sizes else np.zeros(k)
    assert sums.max() - sums.min() <= max(sizes, default=0)


def plain_karmarkar_karp(sizes, k):
    """Sums of the shards, by the definition: the two of largest spread are added in opposite order until one is left."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0] if parts else [0] * k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 1 << 40), max_size=40, unique=True), st.integers(2, 6))
def test_differencing_equals_plain_karmarkar_karp(sizes, k):
    parts = np.zeros((len(sizes), k), np.int64)
    parts[:, 0] = sizes
    shard = sharding.difference(parts)[:, 0]
    sums = [sum(s for s, x in zip(sizes, shard, strict=True) if x == j) for j in range(k)]
    assert sorted(sums, reverse=True) == plain_karmarkar_karp(sizes, k)


def test_a_group_above_a_fair_share_is_alone(spark):
    rng = np.random.default_rng(3)
    sizes = [3_000_000, *(rng.integers(16, 4000, 3000)).tolist()]
    groups = spark.createDataFrame([(f"{i:04d}", int(s)) for i, s in enumerate(sizes)], "digest string, bytes long")
    for bucket_groups in (4000, 500):
        got = {r.digest: r.shard for r in sharding.group_shards(groups, 8, bucket_groups=bucket_groups).collect()}
        sums = np.zeros(8)
        for i, s in enumerate(sizes):
            sums[got[f"{i:04d}"]] += s
        assert sums.max() == 3_000_000
        rest = np.sort(sums)[:-1]
        assert rest.max() - rest.min() < 0.01 * rest.mean()


@pytest.mark.parametrize("max_items", [8000, 300])
def test_group_shards_are_even_with_and_without_bundles(spark, max_items):
    rng = np.random.default_rng(1)
    sizes = np.minimum((rng.pareto(1.5, 700) * 1000).astype(int) + 16, 90_000)
    groups = spark.createDataFrame([(f"{i:04d}", int(s)) for i, s in enumerate(sizes)], "digest string, bytes long")
    got = {r.digest: r.shard for r in sharding.group_shards(groups, 8, max_items).collect()}
    assert len(got) == 700
    sums = np.zeros(8)
    for i, s in enumerate(sizes):
        sums[got[f"{i:04d}"]] += s
    assert sums.max() - sums.min() < 0.01 * sums.mean()


def check_shards(rows, texts):
    slots, where = defaultdict(list), {}
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
            assert where.setdefault(text, r.shard) == r.shard


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    check_shards(rows, {r.doc_id: r.text for r in docs.collect()})
    assert len(rows) == docs.count()
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) / (sum(sums.values()) / 40) < 1.01


def test_shards_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, {i: t for i, t, _ in ODD})
    assert sharding.shard(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing_equals_the_plain_search(lengths):
    rows = packing.best_fit_decreasing(lengths, 64)
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(64 - n)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(free)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 3000])
def test_packed_rows_hold_every_document(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "lang AS source", "0L AS n_chars"))
    tok = Tokenizer.from_file(PATH)
    parts, rows = defaultdict(list), packing.pack(docs, row_tokens=512, block_tokens=block).collect()
    assert len({r.row_id for r in rows}) == len(rows)
    for r in rows:
        assert len(r.ids) == len(r.position_ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.ids[r.n_tokens :] == [packing.PAD] * (512 - r.n_tokens)
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert r.position_ids[a:b] == list(range(b - a))
            parts[r.doc_ids[k]].append((r.doc_offsets[k], r.ids[a:b]))
    want = defaultdict(list)
    for d in docs.collect():
        want[d.doc_id] += tok.encode(d.text or "", add_special_tokens=False).ids
    got = {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()}
    repeated = {100003}
    assert {d: x for d, x in got.items() if d not in repeated} == {d: x for d, x in want.items() if x and d not in repeated}
    assert sorted(got[100003]) == sorted(want[100003])
    assert packing.pack(docs.limit(0)).count() == 0


def test_binary_rows_hold_the_same_ids(spark, tmp_path):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    packed = packing.pack(docs, row_tokens=64)
    packing.pack(docs, row_tokens=64, width=2).write.parquet(str(tmp_path / "b"))
    got = {r.row_id: (np.frombuffer(r.ids, "<u2").tolist(), np.frombuffer(r.position_ids, "<u2").tolist(), r.cu_seqlens) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert got == {r.row_id: (r.ids, r.position_ids, r.cu_seqlens) for r in packed.collect()}


def test_padding_is_no_token():
    assert packing.PAD not in Tokenizer.from_file(PATH).get_vocab().values() and packing.PAD < 1 << 16


@pytest.mark.parametrize("text", ["a" + "\n" * 100_000 + "b", "x" * 200_000, "ab1 " * 50_000, "it's  a\n\n b", "", "<|endoftext|>", "a <|endoftext|> b", "a <|endoftext|>" + " " * 5000 + "b<|endoftext|>"])
def test_long_texts_are_encoded_whole(text):
    fast = packing.tokenizer(public_tokenizers.path(packing.DEFAULT), PATH)
    assert packing.encoded(text, fast, PATH).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def greedy(word, first, later):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return 1
        n, at = n + 1, end
    return n


@settings(max_examples=500, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=12), st.one_of(st.none(), st.sets(st.text("ab", min_size=1, max_size=5), max_size=12)), st.text("abc", max_size=20))
def test_automaton_equals_greedy_search(first, later, word):
    first = {x.encode() for x in first}
    later = None if later is None else {x.encode() for x in later}
    assert wordpiece.LongestMatch(first, later).count(word.encode()) == greedy(word.encode(), first, first if later is None else later)


def test_counts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("doc_id + 100000 AS doc_id", "text"))
    vocab = set(bpe.ByteBpe(PATH).tokens)
    own = bpe.ByteBpe(PATH)
    memo = {}

    def count(text):
        total = 0
        for p in own.fine.findall(text):
            if p not in memo:
                memo[p] = greedy(p.encode(), vocab, vocab)
            total += memo[p]
        return total

    got = sorted(((r.doc_id or 0, r.n_tokens) for r in wordpiece.token_counts(docs).collect()))
    assert got == sorted((r.doc_id or 0, count(r.text or "")) for r in docs.collect())


def test_counts_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, "x", 5), (2, "", None, None), (3, "a b", "y", 1), (3, "a b", "y", 1), (None, "a b", "z", 2)], "doc_id long, text string, n_tokens string, ids long")
    assert sorted(((r.doc_id or 0, r.n_tokens) for r in wordpiece.token_counts(rows).collect())) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    empty = wordpiece.token_counts(rows.where("doc_id > 99"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens"]
