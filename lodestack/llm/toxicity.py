"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are all words, and word beginnings, that an example has; a term's weight is its count times a power of its inverse document
frequency, and no label has a part in it. A word that no example has meets nothing: it counts in a vector's length alone, as a word of no
document; beginnings that no example has don't count. Examples stand in blocks, those of like words, so of one language, side by side in a
section. A term that is common in a section is kept there by block, with the largest weight in each block: it bounds what the term adds to
a block, and blocks that can't reach the k nearest are skipped without changing the result. The query takes a text apart once: its bag of
terms is written, counted and scored. Neighbours vote by closeness, and a logistic curve fitted on the examples themselves, each without its own vote, turns votes into probabilities.
Examples are a bounded sample of labelled rows; document frequencies come from all documents.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.bpe import Memo, texts_of
from lodestack.llm.common import crc32_mod5, documents, keep

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
MEMO_ENTRIES = 200_000
#: Texts that are searched for at once.
TEXTS = 256
#: A term gets a row in a section where its share of the examples there, times that of all, is over this.
ROW = 0.008
#: Postings of whole weights up to this are repeated instead.
REPEATED = 8
#: Terms of lower numbers travel in two bytes.
SHORT = 1 << 16


@dataclass(frozen=True)
class Settings:
    #: Labelled documents of each class to learn from, about; chosen by a hash of the id.
    examples_per_class: int = 3000
    idf_power: float = 2.0
    neighbours: int = 100
    block: int = 64
    #: What a document without neighbours would have as the sum of votes, dealt by the classes' shares.
    prior: float = 0.05


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, those marked by a star."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


class Words(dict):
    """The terms of a word as numbers, in bytes: a text's are joined and read as one array.

    Only words that an example has are remembered, as the others are without end; what a word shares with others of its beginning is looked up.
    """

    def __init__(self, at: dict[str, int]):
        super().__init__()
        self.at = at
        self.beginnings = Memo(lambda key: np.array([at[t] for t in terms_of(key)[1:] if t in at], np.int32).tobytes(), MEMO_ENTRIES)

    def __missing__(self, word: str) -> bytes:
        # no beginning is longer than the longest: one more letter stands for all that follow
        own = self.at.get(word, len(self.at))
        value = own.to_bytes(4, sys.byteorder) + self.beginnings[word if len(word) <= BEGINNINGS[-1] else word[: BEGINNINGS[-1]] + "*"]
        if own < len(self.at):
            self[word] = value
        return value


class Vectors:
    """Unit TF-IDF vectors over the terms of all examples, given in order; idf[k] weighs term k and idf[-1] the words that no example has."""

    def __init__(self, terms: pa.Array, idf: np.ndarray):
        self.terms, self.idf = terms, idf

    def __getstate__(self):
        return {"terms": self.terms, "idf": self.idf}

    def __getattr__(self, name: str):
        # the tables are made where they are first used: in the tasks
        if name not in ("memo", "last"):
            raise AttributeError(name)
        at = {t: k for k, t in enumerate(self.terms.to_pylist())}
        self.last = np.zeros(len(at) + 1, np.int64)
        self.memo = Words(at)
        return self.__dict__[name]

    def frequencies(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms, how often each occurs, and how often each unknown word does."""
        counts = Counter(WORD.findall(text.lower()))
        found = list(map(self.memo.__getitem__, counts))
        ids = np.frombuffer(b"".join(found), np.int32)
        times = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), np.fromiter(map(len, found), np.int64, len(found)) // 4)
        # each term is counted where it stands last
        place = np.arange(len(ids))
        self.last[ids] = place
        last = self.last[ids]
        known = ids < len(self.terms)
        own = known & (last == place)
        return ids[own], np.bincount(last, times, len(ids))[own], times[~known]

    def length(self, weights: np.ndarray, lost: float = 0.0) -> float:
        """The length of a vector of known terms' weights and unknown words, lost being the sum of their squared counts."""
        return max(float(np.sqrt(weights @ weights + lost * self.idf[-1] ** 2)), 1e-300)


class Bag:
    """The terms of a text as they are written: (common, rare, times, lost), the known terms of low and of higher numbers, how often each
    occurs, in a byte each where that holds all, and the sum of the squared counts of unknown words."""

    SCHEMA = "doc_id long, common binary, rare binary, times binary, lost double"

    @staticmethod
    def of(ids: np.ndarray, times: np.ndarray, lost: np.ndarray) -> tuple[bytes, bytes, bytes, float]:
        common = ids < SHORT
        times = np.concatenate([times[common], times[~common]])
        return ids[common].astype(np.uint16).tobytes(), ids[~common].astype(np.int32).tobytes(), times.astype(np.uint8 if times.max(initial=0) < 256 else np.int32).tobytes(), float(lost @ lost)

    @staticmethod
    def read(common: bytes, rare: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and how often each occurs."""
        ids = np.concatenate([np.frombuffer(common, np.uint16), np.frombuffer(rare, np.int32)], dtype=np.int32)
        return ids, np.frombuffer(times, np.uint8 if len(times) == len(ids) else np.int32).astype(np.float64)

    @staticmethod
    def batch(doc_ids: pa.Array, bags: list[tuple[bytes, bytes, bytes, float]]) -> pa.RecordBatch:
        columns = list(zip(*bags, strict=True)) or [()] * 4
        return pa.record_batch([doc_ids, *[pa.array(c, pa.binary()) for c in columns[:3]], pa.array(columns[3], pa.float64())], ["doc_id", "common", "rare", "times", "lost"])


class Postings:
    """The examples that have each term, in bytes: those of a text's terms are joined and read as one array. Without weights each counts once."""

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray | None, n_terms: int, places: int):
        self.places, self.type = places, np.min_scalar_type(places)
        n = np.bincount(term, minlength=n_terms)
        self.n, ends = n.astype(np.int32), np.cumsum(n)
        self.examples = self._cut(example.astype(self.type), ends)
        self.weights = None if weight is None else self._cut(weight, ends)

    @staticmethod
    def _cut(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, at = values.tobytes(), (ends * values.itemsize).tolist()
        return [data[s:e] for s, e in zip([0, *at], at, strict=False)]

    def add(self, idx: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these terms give to every example."""
        n = self.n[idx]
        some = np.flatnonzero(n)
        found, gives = idx[some].tolist(), np.repeat(weights[some], n[some])
        if self.weights is not None:
            gives *= np.frombuffer(b"".join([self.weights[t] for t in found]))
        return np.bincount(np.frombuffer(b"".join([self.examples[t] for t in found]), self.type), gives, self.places)


class BlockMaxIndex:
    """Postings by term over examples that stand in blocks of `block`; blocks of one cluster are a section.

    An example's weights are those of its vector over its length, 1 unless given. A term that is common enough in a section is kept there
    as a row over its blocks, with the largest weight in each. Other lists are so short that a block has a posting or two: to add them up
    costs what a bound would, and is exact. Clusters change what is skipped, never what is found.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int, lengths: np.ndarray | None = None, clusters: np.ndarray | None = None):
        n = self.n = len(vectors)
        self.block, self.blocks = block, max(1, -(-n // block))
        places = self.blocks * block
        sizes = np.array([len(i) for i, _ in vectors], np.int64)
        order = np.arange(n) if clusters is None else np.lexsort((np.arange(n), sizes, clusters))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        #: The number of the example at each place, and one over its length.
        self.number = np.append(order, np.full(places - n, n))
        self.shorten = np.ones(places)
        if lengths is not None:
            self.shorten[:n] = 1 / lengths[order]
        found, section = np.unique(np.zeros(self.blocks, np.int64) if clusters is None or not n else clusters[order][::block], return_inverse=True)
        #: First and last block of each section.
        self.sections = [(int(at[0]), int(at[-1]) + 1) for at in (np.flatnonzero(section == c) for c in range(len(found)))]
        term = np.concatenate([i for i, _ in vectors]).astype(np.int32) if n else np.zeros(0, np.int32)
        weight = np.concatenate([w for _, w in vectors]).astype(np.float64) if n else np.zeros(0)
        example = np.repeat(place.astype(np.int32), sizes)
        key = term * np.int64(len(found)) + section[example // block]
        by_key = np.argsort(key, kind="stable")
        term, example, weight, key = term[by_key], example[by_key], weight[by_key], key[by_key]
        del by_key
        # in a section a row costs a product for each example, a list a slower step for each that has the term, if a text has it
        first = np.flatnonzero(np.diff(key, prepend=-1))
        here = np.diff(np.append(first, len(key)))
        room = np.array([(e - s) * block for s, e in self.sections], np.int64)[key[first] % len(found)]
        common = np.bincount(term, minlength=n_terms)[term[first]]
        long = np.repeat(here * common > ROW * room * n, here)
        del key, first, here, room, common
        self.heavy = np.unique(term[long])
        self.row = np.full(n_terms, -1, np.int32)
        self.row[self.heavy] = np.arange(len(self.heavy))
        rows, of, at = self.row[term[long]], section[example[long] // block], example[long]
        weights = weight[long] * self.shorten[at]
        self.rows, self.by_block, self.bound = [], [], []
        for c, (s, e) in enumerate(self.sections):
            own = of == c
            here = np.unique(rows[own])
            by_row = np.zeros((len(here), (e - s) * block))
            by_row[np.searchsorted(here, rows[own]), at[own] - s * block] = weights[own]
            by_row = by_row.reshape(len(here), e - s, block)
            self.rows.append(here)
            self.by_block.append(np.ascontiguousarray(by_row.transpose(1, 0, 2)))
            self.bound.append(by_row.max(2, initial=0.0))
        # a small count is repeated, so that few weights are read at all
        small = ~long & (weight >= 1) & (weight <= REPEATED) & (weight == np.floor(weight))
        times, more = weight[small].astype(np.int64), ~long & ~small
        self.once = Postings(np.repeat(term[small], times), np.repeat(example[small], times), None, n_terms, places)
        self.more = Postings(term[more], example[more], weight[more], n_terms, places)

    def _scores(self, queries: np.ndarray, weights: list[np.ndarray], blocks: np.ndarray, out: np.ndarray) -> None:
        """Put the scores of the examples of these blocks, all of one section, in out, which starts as what light terms give; row q of out is a query's."""
        c = next(c for c, (_, e) in enumerate(self.sections) if blocks[0] < e)
        own = weights[c] if len(queries) == len(out) else weights[c][queries]
        for b in blocks.tolist():
            given = own @ self.by_block[c][b - self.sections[c][0]]
            if len(queries) == len(out):
                out[:, b] += given
            else:
                out[queries, b] += given

    def _light(self, idx: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What terms give to every example where they have no row."""
        out = (self.once.add(idx, weights) + self.more.add(idx, weights)) * self.shorten
        return out.reshape(self.blocks, self.block)

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], ks: int | list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of some queries at once: blocks are read once for all that need them."""
        ks = [ks] * len(queries) if isinstance(ks, int) else ks
        scores = np.empty((len(queries), self.blocks, self.block))
        heavy = np.zeros((len(self.heavy), len(queries)))
        for q, (idx, weights) in enumerate(queries):
            rows = self.row[idx]
            long = rows >= 0
            heavy[rows[long], q] = weights[long]
            scores[q] = self._light(idx, weights)
        weights = [np.ascontiguousarray(heavy[rows].T) for rows in self.rows]
        bound = scores.max(2)
        for w, largest, (s, e) in zip(weights, self.bound, self.sections, strict=True):
            bound[:, s:e] += w @ largest
        step = max(1, -(-2 * max(ks, default=1) // self.block))
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, np.argsort(-bound, axis=1, kind="stable")[:, :step], True, axis=1)
        wanted &= bound > 0
        met = np.zeros_like(wanted)
        least = np.zeros(len(queries))
        while wanted.any():
            for s, e in self.sections:
                # blocks that the same queries want are read together
                together = defaultdict(list)
                for b in (s + np.flatnonzero(wanted[:, s:e].any(0))).tolist():
                    together[wanted[:, b].tobytes()].append(b)
                for blocks in together.values():
                    self._scores(np.flatnonzero(wanted[:, blocks[0]]), weights, np.array(blocks), scores)
            met |= wanted
            for q, k in enumerate(ks):
                own = scores[q, met[q]].ravel()
                least[q] = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else 0.0
            # rounding aside, no example of a block scores more than its bound
            wanted = (bound > 0) & (bound >= least[:, None] - 1e-9) & ~met
        out = []
        for q, k in enumerate(ks):
            # only what can be among the k is put in order
            blocks = np.flatnonzero(met[q])
            own = scores[q, blocks]
            at, place = np.nonzero(own >= max(least[q] - 2e-9, 1e-300))
            best, rounded = self.number[blocks[at] * self.block + place], np.round(own[at, place], 9)
            order = np.lexsort((best, -rounded))[:k]
            order = order[rounded[order] > 0]
            out.append((best[order], rounded[order]))
        return out

    def nearest(self, idx: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine, if over 0, and their cosines; equal ones by number. Exact."""
        return self.nearest_each([(idx, weights)], k)[0]


def clusters_of(terms: np.ndarray, sizes: np.ndarray, n_terms: int, clusters: int = 16, rounds: int = 8, commonest: int = 1024) -> np.ndarray:
    """A cluster for each example by the cosine of its commonest terms, by k-means; terms are those of one example after the other."""
    n = len(sizes)
    frequency = np.bincount(terms, minlength=n_terms)
    used = np.argsort(-frequency, kind="stable")[:commonest]
    row = np.full(n_terms, -1, np.int64)
    row[used] = np.arange(len(used))
    rows = row[terms]
    known = rows >= 0
    vectors = np.zeros((n, len(used)), np.float32)
    vectors[np.repeat(np.arange(n), sizes)[known], rows[known]] = np.log((1 + n) / frequency[used])[rows[known]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = vectors[np.random.default_rng(0).choice(n, min(clusters, n), replace=False)]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([vectors[own == c].sum(0) for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.argmax(vectors @ centres.T, axis=1)


@dataclass
class Examples:
    """Labelled examples: the terms of one after the other and how often each occurs, sizes[e] of them for example e.

    It travels as these small numbers; the index over them is made where it is first used: in the tasks.
    """

    vectors: Vectors
    terms: np.ndarray
    times: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    clusters: np.ndarray
    class_weight: np.ndarray
    shares: np.ndarray
    settings: Settings

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def __getattr__(self, name: str):
        if name != "index":
            raise AttributeError(name)
        ends = np.cumsum(self.sizes)
        parts = [(self.terms[e - n : e], self.times[e - n : e].astype(np.float64)) for n, e in zip(self.sizes.tolist(), ends.tolist(), strict=True)]
        # counts are indexed, most of which are 1; the terms' weights are those of the texts searched for
        lengths = np.array([self.vectors.length(t * self.vectors.idf[i]) for i, t in parts])
        self.index = BlockMaxIndex(parts, len(self.vectors.terms), self.settings.block, lengths, self.clusters)
        return self.index

    def query(self, common: bytes, rare: bytes, times: bytes, lost: float) -> tuple[np.ndarray, np.ndarray]:
        """What the index is asked for a bag: the weights in its unit vector, times those that the examples' counts are without."""
        ids, n = Bag.read(common, rare, times)
        idf = self.vectors.idf[ids]
        weights = n * idf
        return ids, weights * idf / self.vectors.length(weights, lost)

    def bags(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes, float]]:
        return [Bag.of(*self.vectors.frequencies(t)) for t in texts]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """The log of the weighted vote for label 1 over that for label 0, each with a little prior."""
        w, label = cosine * self.class_weight[self.labels[best]], self.labels[best]
        one, all_ = float(w @ label), float(w.sum())
        prior = self.settings.prior * self.shares
        return float(np.log(one + prior[1]) - np.log(all_ - one + prior[0]))

    def votes_without(self, bags: list[tuple[bytes, bytes, bytes, float]], doc_ids: list[int]) -> list[float]:
        """The votes on examples' bags of all examples but those of their id."""
        own = [int((self.ids == i).sum()) for i in doc_ids]
        out = []
        for (best, cosine), i in zip(self.nearest_each(bags, own), doc_ids, strict=True):
            others = self.ids[best] != i
            out.append(self.vote(best[others][: self.settings.neighbours], cosine[others][: self.settings.neighbours]))
        return out

    def nearest_each(self, bags: list[tuple[bytes, bytes, bytes, float]], more: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each bag, as many more as wanted."""
        ks = [self.settings.neighbours + n for n in (more or [0] * len(bags))]
        for k in range(0, len(bags), TEXTS):
            yield from self.index.nearest_each([self.query(*b) for b in bags[k : k + TEXTS]], ks[k : k + TEXTS])


@dataclass
class Model:
    """Examples, broadcast once, and the curve from votes to probabilities."""

    examples: Broadcast
    slope: float
    offset: float

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with a small ridge, by Newton steps."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def idf_of(frequency: np.ndarray, documents: int, power: float) -> np.ndarray:
    """The weight of terms by the number of documents that have them; the last is for terms of no document."""
    return np.log((1 + documents) / (1 + np.append(frequency, 0))) ** power


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of docs(doc_id, text) and labels(doc_id, toxic), all of which may be learned from.

    Labels that are null, or of documents that aren't there, teach nothing; of repeated labels the largest counts.
    """
    return learn_bags(docs, labels, settings)[0]


def learn_bags(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """learn(), and docs as written bags of terms, for score_bags."""
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    per_class = {r["toxic"]: r["n"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, settings.examples_per_class / max(1, per_class.get(c, 0))) for c in (0, 1)]
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * F.lit(float(1 << 30))
    # examples_per_class of each class, give or take the hash; the limit proves the bound
    chosen = labels.where("toxic in (0, 1)").where(drawn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(4 * settings.examples_per_class)
    sample = keep(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), "toxicity-examples")

    def examples_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                n.update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
        yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    # the commonest terms come first: what most texts need lies close together in memory
    with_term = sample.select("text").mapInArrow(examples_with, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    with_term = with_term.sort_by([("n", "descending"), ("term", "ascending")])
    terms = with_term["term"].combine_chunks()
    counting = spark.sparkContext.broadcast(Vectors(terms, np.ones(len(terms) + 1)))

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield Bag.batch(batch.column(0), [Bag.of(*counting.value.frequencies(t)) for t in texts_of(batch.column(1))])

    # texts are taken apart once, to be counted here and scored afterwards
    bags = keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(bags_of, Bag.SCHEMA), "toxicity-bags")
    n_terms = len(terms)

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for column, kind in zip(batch.columns, (np.uint16, np.int32), strict=True):
                seen[:-1] += np.bincount(np.frombuffer(b"".join(column.to_pylist()), kind), minlength=n_terms)
            seen[-1] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at])], ["term", "n"])

    counted = bags.select("common", "rare").mapInArrow(count_documents, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(terms) + 1, np.int64)
    frequency[counted["term"].to_numpy()] = counted["n"].to_numpy()

    def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counting.value.frequencies(t)[:2] for t in texts_of(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([t.astype(np.int32).tobytes() for _, t in found], pa.binary())], ["doc_id", "toxic", "terms", "times"])

    got = sample.mapInArrow(example_terms, "doc_id long, toxic int, terms binary, times binary").toArrow()
    counting.destroy()
    found = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(t.as_buffer(), np.int32)) for i, t in zip(got["terms"], got["times"], strict=True)]
    ids, labels_of = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    # equal cosines go by this order
    rank = np.empty(len(terms), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    leading = [int(rank[i[np.argmax(frequency[i])]]) if len(i) else -1 for i, _ in found]
    order = np.lexsort((ids, [len(i) for i, _ in found], labels_of, leading)) if found else np.zeros(0, np.int64)
    ids, labels_of, found = ids[order], labels_of[order], [found[e] for e in order.tolist()]
    times = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int32)
    of = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.int32)
    sizes = np.array([len(i) for i, _ in found], np.int64)
    # examples of one language side by side make tight bounds
    clusters = clusters_of(of, sizes, len(terms)) if found else np.zeros(0, np.int64)
    weight = np.array([1 / s for s in share])
    weight /= weight.max()
    shares = np.array([weight[c] * max(1, int((labels_of == c).sum())) for c in (0, 1)])
    examples = spark.sparkContext.broadcast(
        Examples(
            Vectors(terms, idf_of(frequency[:-1], int(frequency[-1]), settings.idf_power)),
            of, times.astype(np.min_scalar_type(int(times.max(initial=0)))), sizes,
            labels_of, ids, clusters, weight, shares / shares.sum(), settings,
        )
    )
    n1 = int(labels_of.sum())
    if not 0 < n1 < len(labels_of):
        return Model(examples, 0.0, (20.0 if n1 else -20.0) if len(labels_of) else 0.0), bags

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = examples.value
            x = own.votes_without(own.bags(list(texts_of(batch.column(2)))), batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(1), pa.array(x, pa.float64())], ["toxic", "x"])

    cast = sample.repartition(max(1, len(labels_of) // 500)).mapInArrow(votes, "toxic int, x double").toArrow()
    y = cast["toxic"].to_numpy().astype(np.int64)
    return Model(examples, *_logistic(cast["x"].to_numpy(), y.astype(np.float64), weight[y])), bags


OUT = "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>"


def _scored(model: Model, doc_ids: pa.Array, bags: list[tuple[bytes, bytes, bytes, float]], evidence: int) -> pa.RecordBatch:
    own = model.examples.value
    out = list(own.nearest_each(bags))
    scores = [model.probability(own.vote(best, cosine)) for best, cosine in out]
    return pa.record_batch([doc_ids, pa.array(scores, pa.float64()), pa.array([own.ids[b[:evidence]].tolist() for b, _ in out], pa.list_(pa.int64())), pa.array([c[:evidence].tolist() for _, c in out], pa.list_(pa.float64()))], [x.split()[0] for x in OUT.split(", ")])


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """doc_id, score and the nearest examples with their cosines for each of docs(doc_id, text).

    Null and empty texts, and those without a term of any example, have no neighbours and get the score of an even draw from the
    classes. Rows are scored by their text alone, so repeated rows agree. Without labels of both classes every score is the same: 0.5
    without any. An empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(model, batch.column(0), model.examples.value.bags(list(texts_of(batch.column(1)))), evidence)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def score_bags(bags: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """score() of the documents that the model was learned from, without taking their texts apart again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(model, batch.column(0), list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)), evidence)

    return bags.mapInArrow(run, OUT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_mod5(F.col("doc_id")) != 0)
    model, bags = learn_bags(docs, labels)
    found = score_bags(bags, model)
    return found.select("doc_id", (crc32_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")
