"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine c or more lie within epsilon = sqrt(2 - 2c). Projected on leading principal directions, a pair differs by
epsilon at most in each, so by one grid cell at most. Vectors are sorted by their cells; the sequence is cut into
intervals of bounded length, written with their bounding boxes, and interval pairs whose boxes are within epsilon are
joined recursively: halves whose boxes are farther apart are skipped, small pieces compared in double precision.
Equal vectors are one row in all of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import connected_components, keep

THRESHOLD = 0.93
INTERVAL_ROWS = 2048
LEAF_ROWS = 256
#: Intervals that one interval is joined with in a task.
PARTNERS = 16
AXES = 6
#: Vectors that the principal directions are fitted on, about. They only steer what can be skipped.
AXES_SAMPLE = 4000


def comparable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def digest_of() -> Column:
    return F.struct(F.xxhash64("kind", "vector").alias("h"), F.xxhash64(F.lit("second"), "vector", "kind").alias("g"))


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, axes: int = AXES, sample: int = AXES_SAMPLE) -> dict[int, np.ndarray]:
    """For each number of dimensions the leading principal directions of a bounded sample, chosen by a hash of the vector."""
    n = vectors.count()
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < F.lit(min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = vectors.where(share).select(F.col("vector").cast("array<double>")).limit(2 * sample).toPandas()["vector"]
    out = {}
    for dims in sorted({len(v) for v in rows}):
        found = units(np.stack([v for v in rows if len(v) == dims]))
        _, directions = np.linalg.eigh(np.cov(found, rowvar=False).reshape(dims, dims) if len(found) > 1 else np.eye(dims))
        out[dims] = directions[:, ::-1][:, :axes].T
    return out


def projected(unit: np.ndarray, directions: dict[int, np.ndarray], axes: int) -> np.ndarray:
    """Coordinates on `axes` directions; where none were fitted, the first components; missing ones are 0."""
    dims = unit.shape[1]
    found = unit @ directions[dims].T if dims in directions else unit[:, :axes]
    return np.pad(found, ((0, 0), (0, axes - found.shape[1])))


def intervals(distinct: DataFrame, epsilon: float, axes: int = AXES, rows: int = INTERVAL_ROWS) -> DataFrame:
    """The grid order of distinct(kind, dims, vector, rep, n) cut into intervals of one kind and number of dimensions.

    Columns: id, kind, dims, low, high (the bounding box), and packed vectors, reps and counts.
    """
    directions = principal_axes(distinct.select("vector"), axes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("dims"):
                at = projected(units(np.stack(part["vector"].to_numpy())), directions, axes)
                cells = np.floor(at / epsilon).astype(np.int32)
                yield part.assign(**{f"c{k}": cells[:, k] for k in range(axes)}, at=list(at))

    cells = [f"c{k}" for k in range(axes)]
    order = ["kind", "dims", *cells, "rep"]
    placed = distinct.mapInPandas(place, "kind string, dims int, vector array<double>, rep long, n long, " + ", ".join(f"{c} int" for c in cells) + ", at array<double>")
    n_parts = max(1, -(-distinct.count() // (4 * rows)))
    ordered = placed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held = TaskContext.get().partitionId() << 32, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            for _, part in list(held.groupby(["kind", "dims"], sort=False))[:-1]:
                for k in range(0, len(part), rows):
                    yield packed(part[k : k + rows], first)
                    first += 1
            last = held.iloc[-1] if len(held) else None
            if last is not None:
                held = held[(held["kind"] == last["kind"]) & (held["dims"] == last["dims"])]
                while len(held) >= 2 * rows:
                    yield packed(held[:rows], first)
                    first, held = first + 1, held[rows:]
        if held is not None:
            for k in range(0, len(held), rows):
                yield packed(held[k : k + rows], first)
                first += 1

    def packed(part: pd.DataFrame, number: int) -> pd.DataFrame:
        at = np.stack(part["at"].to_numpy())
        row = {"id": number, "kind": part["kind"].iloc[0], "dims": part["dims"].iloc[0], "low": at.min(0), "high": at.max(0), "vectors": np.stack(part["vector"].to_numpy()).astype(np.float64).tobytes(), "at": at.tobytes(), "reps": part["rep"].to_numpy(np.int64).tobytes(), "counts": part["n"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([row])

    return ordered.mapInPandas(cut, "id long, kind string, dims int, low array<double>, high array<double>, vectors binary, at binary, reps binary, counts binary")


def near_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b, of boxes(id, kind, dims, low, high) within epsilon; they meet in the cells of the first direction that both reach."""
    boxes = boxes.select("id", "kind", "dims", "low", "high")
    cell = lambda x: F.floor(x / F.lit(epsilon))
    left = boxes.withColumn("cell", F.explode(F.sequence(cell(F.get("low", F.lit(0))), cell(F.get("high", F.lit(0))))))
    right = boxes.withColumn("cell", F.explode(F.sequence(cell(F.get("low", F.lit(0))) - 1, cell(F.get("high", F.lit(0))) + 1)))
    gaps = F.zip_with(F.zip_with("x.low", "y.high", lambda a, b: a - b), F.zip_with("y.low", "x.high", lambda a, b: a - b), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = left.alias("x").join(right.alias("y"), ["kind", "dims", "cell"]).where((F.col("x.id") <= F.col("y.id")) & (distance <= F.lit(epsilon * epsilon)))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


class PairJoin:
    """The recursive join of two intervals: sums of linked counts, and edges that connect what is linked."""

    def __init__(self, a, b, epsilon: float, threshold: float):
        (self.ua, self.pa, self.ra, self.na), (self.ub, self.pb, self.rb, self.nb) = a, b
        self.epsilon, self.threshold, self.same = epsilon, threshold, a is b
        self.links_a, self.links_b = np.zeros(len(self.ra), np.int64), np.zeros(len(self.rb), np.int64)
        self.edges: list[np.ndarray] = []
        self.join(0, len(self.ra), 0, len(self.rb))

    def join(self, i: int, j: int, k: int, m: int) -> None:
        if i == j or k == m:
            return
        twin = self.same and i == k and j == m
        if not twin:
            gap = np.maximum(0, np.maximum(self.pa[i:j].min(0) - self.pb[k:m].max(0), self.pb[k:m].min(0) - self.pa[i:j].max(0)))
            if gap @ gap > self.epsilon**2:
                return
        if max(j - i, m - k) <= LEAF_ROWS:
            self.leaf(i, j, k, m, twin)
        elif twin:
            h = (i + j) // 2
            self.join(i, h, i, h)
            self.join(h, j, h, j)
            self.join(i, h, h, j)
        elif j - i >= m - k:
            self.join(i, (i + j) // 2, k, m)
            self.join((i + j) // 2, j, k, m)
        else:
            self.join(i, j, k, (k + m) // 2)
            self.join(i, j, (k + m) // 2, m)

    def leaf(self, i: int, j: int, k: int, m: int, twin: bool) -> None:
        linked = self.ua[i:j] @ self.ub[k:m].T >= self.threshold
        if twin:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.links_a[i:j] += linked @ self.nb[k:m]
        if not twin:
            self.links_b[k:m] += linked.T @ self.na[i:j]
        left, right, top = self.ra[i:j].copy(), self.rb[k:m].copy(), np.iinfo(np.int64).max
        while True:
            new = np.minimum(left, np.where(linked, right, top).min(1))
            new_right = np.minimum(right, np.where(linked, new[:, None], top).min(0))
            if (new == left).all() and (new_right == right).all():
                break
            left, right = new, new_right
        both = np.stack([np.concatenate([self.ra[i:j], self.rb[k:m]]), np.concatenate([left, right])], 1)
        self.edges.append(both[both[:, 0] != both[:, 1]])

    def result(self) -> pd.DataFrame:
        reps = self.ra if self.same else np.concatenate([self.ra, self.rb])
        links = self.links_a + 0 if self.same else np.concatenate([self.links_a, self.links_b])
        edges = np.unique(np.concatenate(self.edges), axis=0) if self.edges else np.zeros((0, 2), np.int64)
        linked = links > 0
        return pd.DataFrame({"a": np.concatenate([reps[linked], edges[:, 0]]), "b": np.concatenate([reps[linked], edges[:, 1]]), "links": np.concatenate([links[linked], np.zeros(len(edges), np.int64)])})


def joined(blocks: DataFrame, pairs: DataFrame, epsilon: float, threshold: float) -> DataFrame:
    """Rows (a, b, links): links of vector a to others in an interval pair, and edges a-b of links 0.

    An interval meets its partners PARTNERS at a time: it travels once for those, and a task never holds more than they and itself.
    """

    def unpack(row, side: str = ""):
        vectors = np.frombuffer(row[f"{side}vectors"], np.float64).reshape(-1, row[f"{side}dims"])
        return units(vectors), np.frombuffer(row[f"{side}at"], np.float64).reshape(len(vectors), -1), np.frombuffer(row[f"{side}reps"], np.int64), np.frombuffer(row[f"{side}counts"], np.int64)

    def meet(key: tuple, own: pd.DataFrame, partners: pd.DataFrame) -> pd.DataFrame:
        a = unpack(own.iloc[0], "own_")
        return pd.concat([PairJoin(a, a if row["b"] == key[0] else unpack(row), epsilon, threshold).result() for row in partners.to_dict("records")])

    data = ["dims", "vectors", "at", "reps", "counts"]
    nth = F.row_number().over(W.partitionBy("a").orderBy("b")) - 1
    pairs = pairs.withColumn("part", F.floor(nth / PARTNERS).cast("int"))
    own = pairs.select("a", "part").distinct().join(blocks.select(F.col("id").alias("a"), *data), "a")
    # new names for what both sides have from the same tables
    own = own.toDF(*[f"own_{c}" for c in own.columns])
    partners = pairs.join(blocks.select(F.col("id").alias("b"), *data), "b")
    return own.groupBy("own_a", "own_part").cogroup(partners.groupBy("a", "part")).applyInPandas(meet, "a long, b long, links long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have as many dimensions and a cosine, in double precision, of
    threshold or more. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows
    without a vec_id: n_links 0, component_id their own vec_id, kept. n_links counts other rows, equal vectors and
    repeated rows included. component_id is the smallest vec_id reachable; a vec_id that stands at different vectors joins nothing by that.
    An empty table gives no rows; other columns, whatever their names, aren't read.
    """
    # a little wider than the threshold asks, for rounding; each pair is then held against the threshold itself
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    # 0.0 is added so that -0.0 is 0.0 in a vector's digest
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", F.col("label").cast("string").alias("kind"), vector.alias("vector"))
    linkable = F.col("vec_id").isNotNull() & F.col("kind").isNotNull() & comparable(F.col("vector"))
    # 128 bits name a label and vector from here on, so that vectors are shuffled once only
    digest = F.when(linkable, digest_of())
    groups = rows.where(linkable).groupBy("kind", "vector").agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("n"))
    groups = keep(groups.select(digest_of().alias("digest"), "kind", F.size("vector").alias("dims"), "vector", "first", "n", F.monotonically_increasing_id().alias("rep")), "vectors-distinct")
    blocks = keep(intervals(groups.select("kind", "dims", "vector", "rep", "n"), epsilon), "vectors-blocks")
    found = keep(joined(blocks, keep(near_pairs(blocks, epsilon), "vectors-pairs"), epsilon, threshold), "vectors-links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links = 0").select("a", "b"), "vectors").withColumnRenamed("node", "rep")
    known = groups.select("digest", "rep", "first", "n").join(links, "rep", "left").join(parts, "rep", "left")
    known = keep(known.select("digest", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "vectors-known")
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = keep(known.join(least, "component").select("digest", "links", "least"), "vectors-named")
    out = rows.select("vec_id", digest.alias("digest")).join(known, "digest", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false) AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r USING (vec_id) GROUP BY e.vec_id
"""
