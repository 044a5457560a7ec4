import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_rebuilt(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((-(1 << 70) if t is None else t, r or "", hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + rows[h:]
    return out


def plain_trie(sequences):
    """The trie, node by node; every conversation walks down its path, every node's sums walk up to the root."""
    nodes, child = [dict(up=None, depth=0, words=0, members=[], ends=[], n_children=0, leaves=0, saved=0)], {}
    for c in sorted(sequences):
        at = 0
        nodes[0]["members"].append(c)
        for turn in sequences[c]:
            if (at, turn) not in child:
                child[at, turn] = len(nodes)
                nodes[at]["n_children"] += 1
                nodes.append(dict(up=at, depth=nodes[at]["depth"] + 1, words=len(turn[1].encode().split()), members=[], ends=[], n_children=0, leaves=0, saved=0))
            at = child[at, turn]
            nodes[at]["members"].append(c)
        nodes[at]["ends"].append(c)
    for n in nodes:
        up = n
        while up is not None:
            up["leaves"] += not n["n_children"]
            up["saved"] += (len(n["members"]) - 1) * n["words"]
            up = None if up["up"] is None else nodes[up["up"]]
    shown = lambda n: hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()
    return [(n["members"][0], n["depth"], None if n["up"] is None else nodes[n["up"]]["members"][0], len(n["members"]), n["n_children"], n["leaves"], n["saved"], shown(n)) for n in nodes if n["members"]]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def same(df, expected):
    assert rows_of(df) == sorted(expected)


def test_odd_conversations(spark):
    turns = [
        (0, 0, "user", "a b"), (0, 1, None, None), (0, None, "user", "first"), (0, 2, "assistant", "x " * 50_000),
        (1, 0, "user", "only"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "a"), (2, 1, "", ""), (2, 3, "u", "v"),
        (21, 0, "user", "a"), (22, 0, "user", "a"), (None, 0, "user", "nobody's"), (-5, 0, "user", "a"), (-5, 1, "user", "b"), (19, 4, "q", "same"), (18, 4, "q", "same"),
    ]
    df = spark.createDataFrame(turns, SCHEMA).withColumns({"digest": F.lit("clash"), "nth": F.lit(3), "depth": F.lit(None).cast("string")})
    same(T.prefix_trie(df), plain_trie(plain_rebuilt(turns)))


def test_random_conversations(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", ""])) for c in range(300) for t in range(rng.randrange(1, 9))]
    turns += [(2000 + c, t, "user", "copy") for c in range(1500) for t in range(5)]
    rng.shuffle(turns)
    same(T.prefix_trie(spark.createDataFrame(turns, SCHEMA)), plain_trie(plain_rebuilt(turns)))


def sequences_of(spark, sequences):
    rows = [(c, i, hashlib.md5(repr(t).encode()).digest(), len(t[1].split())) for c, turns in sequences.items() for i, t in enumerate(turns)]
    rows += [(c, T.LAST, None, 0) for c in sequences]
    return spark.createDataFrame(rows, "conv_id long, place long, digest binary, words long")


def test_long_conversations_lie_across_partitions_and_stretches(spark):
    base = [("user", f"t {i % 7}") for i in range(3000)]
    sequences = {5: base, 6: base[:1300], 7: [*base[:1299], ("user", "other")], 8: base[:1], 9: [], 3: [*base[:513], ("a", "b")], 11: base[:2999]}
    rows = sequences_of(spark, sequences).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, carries = T.scanned(rows, ["place"], "test-paths")
        assert carries and placed.groupBy("conv_id").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count()
        same(T.trie(rows), plain_trie(sequences))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chains_that_hang_from_each_other(spark):
    # each conversation leaves the path of the one before a turn deeper
    sequences = {c: [("u", f"{i}") for i in range(c)] + [("u", f"leaf {c}")] * 2 for c in range(1, 9)}
    same(T.trie(sequences_of(spark, sequences)), plain_trie(sequences))


def test_ends_beyond_a_block_of_ids(spark):
    sequences = {c: [("u", "hi")] for c in [*range(5000), 1 << 40, (1 << 40) + 1]}
    tries = T.merged(T.partial_tries(sequences_of(spark, sequences)))
    assert tries.agg(F.max(F.size("ids"))).first()[0] <= 1 << T.BLOCK_BITS
    same(T.trie(sequences_of(spark, sequences)), plain_trie(sequences))


def test_powers():
    k = np.array([0, 1, 2, 7, 1000, 123_456_789])
    assert T.powers(k).tolist() == [[pow(b, int(e), T.PRIME) for b in T.BASES] for e in k]


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
