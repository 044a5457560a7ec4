import zlib

import numpy as np
import pytest

from lodestack.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return langid.op5_langid(spark, SF).collect()


def test_held_out_accuracy(spark, found):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id for r in found} == set(labels)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == labels[r.doc_id] for r in held]) > 0.98


def test_mixture_names_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    text = {lang: docs.where(f"lang = '{lang}' and n_chars > 3000").first().text for lang in ("de", "es")}
    lang, score, langs, shares, background = langid.infer(text["de"][:2000] + text["es"][:1000], model)
    assert lang == "de" and set(langs) == {"de", "es"}
    assert 0.55 < score < 0.8 and background < 0.1
    assert langid.infer(text["es"], model)[2] == ["es"]


def test_empty_letterless_and_null(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 2), (3, "12 !", "de", 3), (None, "the the of", "en", 4), (4, "the the of", "en", 5)], "doc_id long, text string, lang string, score int")
    model = langid.learn(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {4, 5}
    nothing = langid.learn(docs.limit(0))
    assert [r.lang_pred for r in langid.identify(docs.where("doc_id = 4"), nothing).collect()] == ["und"]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_long_texts_are_counted_whole():
    table = np.full((langid.BUCKETS, 3), 1.0)
    table[langid.trigrams("aaaa"), 0] += 1e6
    table[langid.trigrams("bbbb"), 1] += 1e6
    model = langid.Model(["x", "y"], (table / table.sum(0)).astype(np.float32))
    lang, score, *_ = langid.infer("a" * 60_000 + "b" * 140_000, model)
    assert lang == "y" and abs(score - 0.7) < 0.05


def test_copies_neither_fill_nor_empty_the_sample(spark):
    settings = langid.Settings(sample_per_language=40)
    many = [(f"kopie {k} mit wort{k}", "de") for k in range(30)] + [("ganz andere zeile", "de")] * 3000
    few = [("una linea muy comun", "es")] * 3000
    with_copies = langid.learn(spark.createDataFrame(many + few, "text string, lang string"), settings)
    distinct = langid.learn(spark.createDataFrame(sorted(set(many + few)), "text string, lang string"), settings)
    assert with_copies.names == distinct.names == ["de", "es"]
    assert np.array_equal(with_copies.table, distinct.table)
    # no column is uniform like the background
    assert all(np.ptp(with_copies.table[:, k]) > 0 for k in range(2))
    assert langid.infer("una linea muy comun", with_copies)[0] == "es"


def test_letters_beyond_the_basic_plane(spark):
    gothic, adlam = "\U00010330\U00010331\U00010332 " * 20, "\U0001e922\U0001e923\U0001e924 " * 20
    assert len(langid.trigrams(gothic)) == 60
    assert np.array_equal(langid.trigrams("\U0001e900"), langid.trigrams("\U0001e922"))  # upper and lower case
    docs = spark.createDataFrame([(1, gothic, "got"), (2, adlam, "ff"), (3, "12 !", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()} == {1: "got", 2: "ff", 3: "und"}


def test_without_a_learned_language_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12 !", None), (3, None, None), (4, "\U00010330", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {1, 4}


def plain_mixture(text, model, settings):
    """EM and the penalised search by the definition, a trigram and a language at a time."""
    import math
    from collections import Counter

    grams = Counter(langid.trigrams(text).tolist())
    n = sum(grams.values())

    def em(columns):
        pi = [1 / len(columns)] * len(columns)
        for _ in range(settings.iterations):
            new = [0.0] * len(columns)
            for g, times in grams.items():
                joint = [w * float(model.table[g, c]) for w, c in zip(pi, columns, strict=True)]
                for k, x in enumerate(joint):
                    new[k] += times * x / sum(joint) / n
            moved = max(abs(a - b) for a, b in zip(new, pi, strict=True))
            pi = new
            if moved < settings.tolerance:
                break
        return pi, sum(t * math.log(sum(w * float(model.table[g, c]) for w, c in zip(pi, columns, strict=True))) for g, t in grams.items())

    rest = len(model.names)
    full, _ = em([*range(rest), rest])
    order, best = sorted(range(rest), key=lambda k: -full[k]), None
    for k in range(1, rest + 1):
        pi, likelihood = em([*order[:k], rest])
        value = likelihood - settings.penalty * k * math.log(n + 1)
        if best is not None and value <= best[0]:
            break
        best = value, order[:k], pi
    _, langs, pi = best
    return [model.names[c] for c in langs], pi[:-1], pi[-1]


def test_mixtures_equal_plain_em(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, settings = langid.learn(docs), langid.Settings()
    texts = [r.text for r in docs.orderBy("doc_id").limit(24).collect() if r.text]
    texts += [a[:400] + " " + b[:700] for a, b in zip(texts, texts[5:])] + ["x 17 zzqj", "a"]
    for text in texts:
        main, score, langs, proportions, background = langid.infer(text, model, settings)
        want = plain_mixture(text[:20000], model, settings)
        assert langs == want[0]
        assert proportions == pytest.approx(want[1], abs=2e-3) and background == pytest.approx(want[2], abs=2e-3)
        assert main == langs[proportions.index(max(proportions))] and score == pytest.approx(max(proportions), abs=1e-9)


def test_a_very_long_text_through_spark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    text = next(r.text for r in docs.where("lang = 'fr'").orderBy("doc_id").limit(1).collect())
    got = langid.identify(spark.createDataFrame([(1, text * (1 + 3_000_000 // len(text)), 0.5), (2, text, 0.1)], "doc_id long, text string, score double"), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["fr", "fr"]
