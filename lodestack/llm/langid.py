"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed letter trigrams, learned from labelled documents. A document is a mixture of
languages and a uniform background: expectation-maximisation estimates the proportions, and the set of languages
grows, by falling proportion, as long as the penalised likelihood does. Spark deals the documents; the model is a bounded
table that every task reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.bpe import texts_of
from lodestack.llm.common import crc32_mod5, documents

BUCKETS = 1 << 16
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    #: Distinct texts of a language to learn from, about; chosen by a hash of the text.
    sample_per_language: int = 4000
    #: Labelled languages at most, which bounds the model at 256 KB for each; more are an error.
    max_languages: int = 256
    smoothing: float = 0.2
    #: Cost of a further language, times the logarithm of the number of trigrams.
    penalty: float = 6.0
    #: EM ends when no proportion moves by more than the tolerance, after so many steps at most.
    tolerance: float = 1e-3
    iterations: int = 200
    #: A document whose background holds more than this is no language; see accepted(). Short texts full of keys or addresses reach a half and are clean.
    max_background: float = 0.8


def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for code in np.flatnonzero(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)).tolist():
        low = chr(code).lower()
        out[code] = ord(low) if len(low) == 1 else code
    return out


LETTERS = _letters()


def trigrams(text: str) -> np.ndarray:
    """A bucket for each letter of the text, hashed with its two neighbours; all but letters count as spaces."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32)
    codes = LETTERS[codes]
    padded = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    here = np.flatnonzero(codes != 32) + 1
    mixed = padded[here - 1] * np.uint32(0x9E3779B1) + padded[here] * np.uint32(0x85EBCA77) + padded[here + 1] * np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


@dataclass
class Model:
    """names[k] has the probabilities table[:, k]; the last column of table is the background."""

    names: list[str]
    table: np.ndarray


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the labelled rows of docs(text, lang).

    Rows with null text or lang teach nothing, and copies of a text teach once for each language. Of a language with more
    than sample_per_language distinct texts, those with the smallest hash are taken, about that many; of others all are.
    """
    docs = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("hash"))
    counts = {r["lang"]: r["n"] for r in docs.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(settings.max_languages + 1).collect()}
    if len(counts) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, settings.sample_per_language / n))).otherwise(share)
    drawn = docs.where(F.pmod("hash", F.lit(1 << 30)) < share * F.lit(float(1 << 30)))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's first of each drawn text, so that the shuffle is bounded however many copies there are
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    sample = drawn.mapInArrow(once, drawn.schema).dropDuplicates(["lang", "hash"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                sums = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "bucket", "n"])

    counted = sample.repartition(max(1, 2 * len(counts))).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts)
    table = np.full((BUCKETS, len(names) + 1), settings.smoothing)
    for k, lang in enumerate(names):
        rows = counted[counted["lang"] == lang]
        table[rows["bucket"], k] += rows["n"]
    table[:, -1] = 1.0
    return Model(names, (table / table.sum(0)).astype(np.float32))


def _proportions(p: np.ndarray, weights: np.ndarray | None, n: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns of p by EM, and the log-likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(settings.iterations):
        share = 1 / (p @ pi)
        new = pi * ((share if weights is None else share * weights) @ p) / n
        new /= new.sum()
        done = np.abs(new - pi).max() < settings.tolerance
        pi = new
        if done:
            break
    ll = np.log(p @ pi)
    return pi, float(ll.sum() if weights is None else ll @ weights)


def infer(text: str, model: Model, settings: Settings = Settings()) -> tuple[str, float, list[str], list[float], float]:
    """The main language, its proportion, the languages of the chosen set and their proportions, and the background's."""
    buckets = trigrams(text)
    if not len(buckets) or not model.names:
        return UNDETERMINED, 0.0, [], [], 1.0
    n, weights = float(len(buckets)), None
    if n > BUCKETS:
        counts = np.bincount(buckets, minlength=BUCKETS)
        buckets = np.flatnonzero(counts)
        weights = counts[buckets].astype(np.float64)
    p = model.table[buckets].astype(np.float64)
    rest = len(model.names)
    full, _ = _proportions(p, weights, n, settings)
    order = np.argsort(-full[:rest], kind="stable")
    best, chosen = -np.inf, None
    for k in range(1, rest + 1):
        cols = [*order[:k].tolist(), rest]
        pi, ll = _proportions(p[:, cols], weights, n, settings)
        value = ll - settings.penalty * k * np.log(n + 1)
        if value <= best:
            break
        best, chosen = value, (order[:k], pi)
    langs, pi = chosen
    main = int(np.argmax(pi[:-1]))
    return model.names[langs[main]], float(min(1.0, pi[main])), [model.names[i] for i in langs], pi[:-1].tolist(), float(pi[-1])


OUT = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>, background double"


def identify(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """lang_pred, score and the mixture for each row of docs(doc_id, text), the whole text counted.

    A text that is null or has no letter is `und` with score 0; so is every text if no language was learned. Of equal
    proportions the language that comes first in the alphabet wins. Repeated rows get equal results.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(t, spread.value, settings) for t in texts_of(batch.column(1))]
            columns = zip(*found, strict=True) if found else [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "lang_pred", "score", "languages", "proportions", "background"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def accepted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without those that are no language: without a letter, or more background than max_background. Columns as they were.

    Learns from the labelled rows of docs outside the held-out fold; if they name no language, every text with a letter
    stays. Rows share the verdict of their text, so a repeated or missing doc_id does no harm.
    """
    model = learn(docs.where(crc32_mod5(F.col("doc_id")) != 0), settings)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def stays(text: str) -> bool:
        if not spread.value.names:
            return len(trigrams(text)) > 0
        _, _, langs, _, background = infer(text, spread.value, settings)
        return bool(langs) and background <= settings.max_background

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([stays(t) for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(crc32_mod5(F.col("doc_id")) != 0))
    found = identify(docs, model)
    return found.select("doc_id", (crc32_mod5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "languages", "proportions", "background")
