"""Phrase collocation mining with merged count-min sketches.

The first pass counts every sequence of one to three words in a count-min sketch for each task; the sketches are merged by adding them up,
block by block. A merged count is never too small, so the second pass need only count, exactly, the sequences whose
count isn't below the least that a phrase must have: nothing frequent is lost, and most of what is rare is never
shuffled. Exact counts are then scored, and phrases that longer ones stand for are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestack.llm.common import documents, keep

LEAST, SHARE, TOP = 10, 50, 2000
LONGEST = 3
UNKNOWN = "und"
#: Breaks end a piece. They, A-Z and the tab are what a text's bytes are mapped from; a "." stands for any break from there on.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes(ord(".") if c in BREAKS else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that are split into words at once; a task's words are numbered anew beyond so many of them. Two stretches hold about a million
#: different words at most, so a number has ID_BITS bits.
STRETCH, WORDS = 1 << 21, 500_000
ID_BITS = 21
#: Distinct sequences that a task combines before it hands them on.
HELD = 2_000_000


@dataclass(frozen=True)
class Sketch:
    """Rows of 2**bits one-byte counters, which stop at 255; so no row and no task needs more than that.

    bytes_per_counter says how many bytes of text there are to a counter of a row, up to 2**max_bits counters. Beyond them
    a sketch lets more through to the exact count, whose result is the same.
    """

    bits: int
    rows: int = 2
    block_bits: int = 16

    @classmethod
    def of(cls, n_bytes: int, bytes_per_counter: int = 32, max_bits: int = 27) -> Sketch:
        return cls(min(max((max(n_bytes, 1) // bytes_per_counter).bit_length(), 16), max_bits))

    def places(self, hashes: np.ndarray, row: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[row])
        return ((hashes * odd) >> np.uint64(64 - self.bits)).astype(np.uint32)

    def empty(self) -> np.ndarray:
        return np.zeros((self.rows, 1 << self.bits), np.uint8)

    def add(self, counters: np.ndarray, hashes: np.ndarray) -> None:
        for row in range(self.rows):
            places = np.sort(self.places(hashes, row))
            first = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.zeros(0, int)
            at, counts = places[first], np.diff(np.append(first, len(places)))
            counters[row, at] = np.minimum(counters[row, at] + np.minimum(counts, 255), 255)

    def counts(self, counters: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([counters[row, self.places(hashes, row)] for row in range(self.rows)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers of words, given as they come; 0 is a break."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.names, self.hashes = [b"."], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        self.hashes.append(xxh64_intdigest(word))
        return number


def stretches(texts: Iterator[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """Words and breaks of texts, about STRETCH bytes at a time; the number says how many in front the stretch before ended with.

    Short texts share a stretch, a break between them; a long one is cut between words.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text.translate(TABLE)
        if len(text) > STRETCH:
            at, before = 0, []
            while at < len(text):
                stop = at + STRETCH
                cut = max(text.rfind(b" ", at, stop), text.rfind(b".", at, stop)) + 1 if stop < len(text) else len(text)
                if cut <= at:
                    # one word fills the stretch
                    ends = [x for x in (text.find(b" ", stop), text.find(b".", stop)) if x >= 0]
                    cut = min(ends, default=len(text) - 1) + 1
                words = text[at:cut].replace(b".", b" . ").split()
                yield before + words, len(before)
                before, at = (before + words)[-(LONGEST - 1) :], cut
            continue
        held += text.replace(b".", b" . ").split()
        held.append(b".")
        size += len(text)
        if size >= STRETCH:
            yield held, 0
            held, size = [], 0
    if held:
        yield held, 0


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, words seen before) of batches of lang and text, language by language within a batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
        for lang in dict.fromkeys(langs):
            own = (texts[i].as_py() or b"" for i, x in enumerate(langs) if x == lang)
            for words, old in stretches(own):
                yield lang, words, old


def sequences(words: Words, lang: str, tokens: list[bytes], old: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, at, hashes) for n of 1 to LONGEST: where sequences of n words without a break begin, and their hashes. What lies among the first
    `old` words altogether was counted before."""
    ids = np.array(list(map(words.__getitem__, tokens)), np.int64)
    own = np.array(words.hashes, np.uint64)[ids]
    whole = ids > 0
    seed = np.uint64(xxh64_intdigest(lang.encode()))
    hashes, fits = own ^ seed, whole
    for n in range(1, LONGEST + 1):
        if n > 1:
            fits = fits[:-1] & whole[n - 1 :]
            hashes = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :]
        hashes = mixed(hashes)
        at = np.flatnonzero(fits)
        at = at[at + n > old]
        yield n, at, hashes[at]
    # ids are needed by the exact count
    yield 0, ids, own


def sketched(docs: DataFrame, sketch: Sketch) -> np.ndarray:
    """The merged sketch of docs(lang, text): each task's counters, added up block by block over all tasks."""
    size = 1 << sketch.block_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, words, any_ = sketch.empty(), Words(), False
        for lang, tokens, old in by_language(batches):
            any_ = True
            if len(words) > WORDS:
                words = Words()
            for n, _, hashes in sequences(words, lang, tokens, old):
                if n:
                    sketch.add(counters, hashes)
        for row in range(sketch.rows if any_ else 0):
            for block in range(1 << (sketch.bits - sketch.block_bits)):
                part = counters[row, block * size : (block + 1) * size]
                if part.any():
                    yield pa.record_batch([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["row", "block", "counters"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([pa.compress(total.astype(np.uint8).tobytes(), "zstd", asbytes=True)], pa.binary())], ["row", "block", "counters"])

        for batch in batches:
            for row, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8).astype(np.uint16)
                if (row, block) != at:
                    if at:
                        yield done()
                    at, total = (row, block), part
                else:
                    total = np.minimum(total + part, 255)
        if at:
            yield done()

    schema = "row int, block int, counters binary"
    parts = docs.mapInArrow(count, schema).repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, schema)
    # bounded by the sketch's size, however many documents there are
    counters = sketch.empty()
    for r in keep(parts, "phrases-sketch").toLocalIterator():
        counters[r["row"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(pa.decompress(bytes(r["counters"]), size, "zstd", asbytes=True), np.uint8)
    return counters


def survivors(docs: DataFrame, sketch: Sketch, counters: np.ndarray, least: int) -> DataFrame:
    """(lang, phrase, n, f): exact counts of all sequences of docs(lang, text) that occur `least` times or more, at most 255; n = 0, with an empty
    phrase, counts a language's words. Each task combines what it counts; whatever the sketch lets through is counted by its words."""
    packed = docs.sparkSession.sparkContext.broadcast(pa.compress(counters.tobytes(), "zstd", asbytes=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(pa.decompress(packed.value, sketch.rows << sketch.bits, "zstd", asbytes=True), np.uint8).reshape(sketch.rows, -1)
        words, totals, n_held = Words(), {}, 0
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[first], np.add.reduceat(counts, first)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = combined(parts)
                for a in range(0, len(keys), 50_000):
                    ids = [(keys[a : a + 50_000] >> s) & ((1 << ID_BITS) - 1) for s in (0, ID_BITS, 2 * ID_BITS)]
                    n = sum((x > 0).astype(np.int32) for x in ids)
                    names = [b" ".join([words.names[i] for i in three if i]) for three in zip(*(x.tolist() for x in ids), strict=True)]
                    yield pa.record_batch([pa.array([lang] * len(n)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n), pa.array(counts[a : a + 50_000])], ["lang", "phrase", "n", "f"])
            held.clear()

        for lang, tokens, old in by_language(batches):
            if len(words) > WORDS or n_held > HELD:
                yield from emit()
                words, n_held = Words(), 0
            found = list(sequences(words, lang, tokens, old))
            ids = found.pop()[1]
            totals[lang] = totals.get(lang, 0) + len(found[0][1])
            keys = []
            for n, at, hashes in found:
                at = at[sketch.counts(table, hashes) >= least]
                keys.append(sum(ids[at + k] << (ID_BITS * k) for k in range(n)))
            distinct = np.unique(np.concatenate(keys), return_counts=True)
            if not len(distinct[0]):
                continue
            held.setdefault(lang, []).append(distinct)
            n_held += len(distinct[0])
            if n_held > HELD:
                for x in held:
                    held[x] = [combined(held[x])]
                n_held = sum(len(k) for [(k, _)] in held.values())
        yield from emit()
        n = len(totals)
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([""] * n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array(list(totals.values()), pa.int64())], ["lang", "phrase", "n", "f"])

    counts = docs.mapInArrow(run, "lang string, phrase string, n int, f long").groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | (F.col("n") == 0))


def exact(*factors: Column) -> Column:
    """A product of counts below 10**13, and one constant, without rounding."""
    out = factors[0].cast("decimal(13,0)")
    for f in factors[1:]:
        out = out * f.cast("decimal(13,0)")
    return out


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of counts(lang, phrase, n, f): every phrase of two words or more, by its lowest-scoring cut."""
    phrases = counts.where("n >= 2")
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("right"))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), cut)).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    part = lambda side, f: counts.where(F.col("n") > 0).select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumns({"over": exact(F.lit(1_000_000), F.col("a"), F.col("a")), "under": exact(F.col("l"), F.col("r"))}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def subsumed(phrases: DataFrame, share: int) -> DataFrame:
    """phrases(lang, phrase, words, a, ...) without those inside a longer one that makes up `share` percent of their occurrences or more."""
    words = F.split("phrase", " ")
    inner = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    longer = phrases.where(F.col("words") > 2).select("lang", "a", F.explode(F.flatten(F.array(*[F.when(F.col("words") > n, inner(n)).otherwise(F.array().cast("array<string>")) for n in range(2, LONGEST)]))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(share) * F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, sketch: Sketch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of docs(lang, text), by score, count and bytes.

    A null text is empty, a null lang is "und"; repeated rows count each time. Other columns, whatever their names, aren't read; no rows give
    none. least is 255 at most, as the sketch's counters stop there. Texts are read a stretch at a time, so a long one needs no more memory than
    itself and a few times a stretch.
    """
    if least > 255:
        raise ValueError("least can't exceed 255")
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    sketch = sketch or Sketch.of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counts = keep(survivors(docs, sketch, sketched(docs, sketch), least), "phrases-counts")
    phrases = subsumed(keep(scored(counts), "phrases-scored"), share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    first = phrases.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counts AS (
  SELECT lang, phrase, words, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1 - k), lambda i: array_to_string(w[i:i + k], ' '))) AS phrase, k + 1 AS words
    FROM worded, (SELECT unnest([0, 1, 2]) AS k)
  ) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, phrase, words, f AS a, k, array_to_string(w[1:k], ' ') AS lhs, array_to_string(w[k + 1:], ' ') AS rhs
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counts WHERE words >= 2)
), scored AS (
  SELECT c.lang, c.phrase, c.words, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = lhs JOIN counts r ON r.lang = c.lang AND r.phrase = rhs
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a FROM best WHERE words = 3
), dropped AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND 100 * g.a >= 50 * b.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM best ANTI JOIN dropped USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
