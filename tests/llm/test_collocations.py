import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import collocations as C

SCHEMA = "lang string, text string"


def plain(docs, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(100 * b >= share * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, x, r, n[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(rows)[:top])}
    return out


def mined(spark, docs, **settings):
    df = spark.createDataFrame(docs, SCHEMA).repartition(5).withColumns({"n": F.lit("clash"), "phrase": F.lit(1), "doc_id": F.lit(None).cast("long")})
    return {tuple(r) for r in C.collocations(df, **settings).collect()}


def random_docs(seed, size=300):
    rng = random.Random(seed)
    vocabulary = ["the", "THE", "of", "new york", "new york city", "a\tb", "é", "x", "É", "\xa0", "rare%d", "end.", "a,b;", "!?", "l\n", "\x0b", "\x1f"]
    return [(rng.choice(["en", "de", None, "und", ""]), " ".join(w % rng.randrange(50) if "%" in w else w for w in rng.choices(vocabulary, k=rng.randrange(60)))) for _ in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counts(spark, seed):
    docs = random_docs(seed)
    expected = plain(docs)
    assert expected and mined(spark, docs) == expected


def test_a_full_sketch_changes_nothing_but_the_work(spark):
    docs = random_docs(7) * 2
    assert mined(spark, docs, sketch=C.Sketch(bits=3, block_bits=2)) == plain(docs)
    assert mined(spark, docs, least=40, share=90, top=5) == plain(docs, 40, 90, 5)


def test_odd_texts(spark):
    docs = [("en", None), ("en", ""), ("fr", " \t "), ("en", "a b " * 200_000), ("en", "y" * 3_000_000 + " a b"), (None, "p q. " * 10), ("de", "p q. " * 9), ("en", "a b " * 200_000)]
    assert mined(spark, docs) == plain(docs)


def test_scores_beyond_64_bits(spark):
    f = 3_000_000_001
    counts = spark.createDataFrame([("en", "a b", 2, f), ("en", "a", 1, f + 2), ("en", "b", 1, 9 * f), ("en", "a b c", 3, 5), ("en", "b c", 2, 7), ("en", "c", 1, 8)], "lang string, phrase string, n int, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in C.scored(counts).collect()}
    assert got == {"a b": (f + 2, 9 * f, 10**6 * f * f // ((f + 2) * 9 * f)), "b c": (9 * f, 8, 10**6 * 49 // (72 * f)), "a b c": (f + 2, 7, 10**6 * 25 // ((f + 2) * 7))}


def test_phrases_that_a_longer_one_stands_for_go(spark):
    docs = [("en", "new york city")] * 10 + [("en", "new york")] * 10 + [("en", "york city")] * 11
    got = {r[2] for r in mined(spark, docs)}
    assert got == {"new york city", "york city"}


def test_sketches_never_count_too_little_and_add_up():
    rng, sketch = np.random.default_rng(1), C.Sketch(bits=8, block_bits=4)
    hashes = C.mixed(rng.zipf(1.3, 20_000).astype(np.uint64))
    whole, parts = sketch.empty(), [sketch.empty() for _ in range(4)]
    sketch.add(whole, hashes)
    for part, own in zip(parts, np.array_split(hashes, 4), strict=True):
        sketch.add(part, own)
    assert np.array_equal(whole, np.minimum(sum(p.astype(int) for p in parts), 255))
    values, counts = np.unique(hashes, return_counts=True)
    assert (sketch.counts(whole, values) >= np.minimum(counts, 255)).all()


def test_long_texts_are_cut_between_words_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 40)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab .\t", k=rng.randrange(400))).encode() for _ in range(40)] + [b"w" * 200 + b" x y", b"z" * 90]
    words, got, whole = C.Words(), Counter(), Counter()
    for tokens, old in C.stretches(iter(texts)):
        for n, at, _ in C.sequences(words, "en", tokens, old):
            if n:
                got.update(b" ".join(tokens[i : i + n]) for i in at.tolist())
    for text in texts:
        for piece in text.split(b"."):
            own = piece.split()
            whole.update(b" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1))
    assert got == whole


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
