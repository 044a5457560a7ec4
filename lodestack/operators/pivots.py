"""Exact nearest neighbours and near pairs by cosine with skipping: vectors in blocks around pivots, bounded by the triangle inequality.

The chord between unit vectors, the square root of twice the cosine distance, is a metric. A block holds vectors of one pivot whose chords to it lie
between two radii; a query at another chord from the pivot is at least the difference away from all of them. Blocks that can't hold anything near enough aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.storage import keep

#: Chords come from rounded dot products; bounds are loosened by so much, and distances count as equal to 9 decimals.
SLACK = 1e-6
RIGHT_ANGLE = float(np.sqrt(2))
MAX_PIVOTS = 256
#: Stretches of blocks meet in so many tiles, and more where a stretch would be larger than so many bytes.
TILES, TILE_BYTES = 64, 64 << 20


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _near(q: np.ndarray, c: np.ndarray, k: int | None, max_distance: float | None, q_short: np.ndarray, c_short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, distance): all pairs within max_distance, or else those where c is among the k nearest of q or as near, to 9 decimals. Single precision only tells what can't be near."""
    if max_distance is not None:
        slack = 1e-5 + 2e-7 * q.shape[1]
        # flat positions are found several times faster than rows and columns
        query, at = np.divmod(np.flatnonzero(q_short @ c_short.T >= np.float32(1 - max_distance - slack)), len(c))
        distance = 1 - np.einsum("ij,ij->i", q[query], c[at])
        within = distance <= max_distance
        return query[within], at[within], distance[within]
    distance = 1 - q @ c.T
    rounded, most = np.round(distance, 9), min(k, len(c)) - 1
    query, at = np.nonzero(rounded <= np.partition(rounded, most, axis=1)[:, most : most + 1])
    return query, at, distance[query, at]


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of rows (block, query, id, distance) the k nearest of each query; equal distances, to 9 decimals, by id."""
    _, query, ids, distance = rows
    order = np.lexsort((ids, np.round(distance, 9), query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return tuple(x[order] for x in rows)


def _frame(rows: tuple[np.ndarray, ...]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("q_block", "query_id", "doc_id", "distance"), rows, strict=True)))


class PivotIndex:
    """corpus(doc_id, vector) in blocks, written once. Rows without a vector are left out; a vector meets those of its own length only.

    n_pivots vectors of each length, picked by a hash of their ids, come to the driver and go to every task: by default one for each block that there is to fill, MAX_PIVOTS
    at most. They steer what is skipped, not what is found. A zero vector belongs to no pivot (-1) and is at distance 1 from all.
    """

    def __init__(self, corpus: DataFrame, n_pivots: int | None = None, block_rows: int = 1024):
        rows = corpus.select(F.col("doc_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("size(v) > 0").withColumn("dims", F.size("v"))
        if n_pivots is None:
            n_pivots = min(max(rows.count() // block_rows, 1), MAX_PIVOTS)
        order = W.partitionBy("dims").orderBy(F.xxhash64("id"), "id")
        picked = rows.where(F.exists("v", lambda x: x != 0)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n_pivots).orderBy("dims", "n").collect()
        self.pivots = {d: _unit(np.array([r["v"] for r in picked if r["dims"] == d])) for d in sorted({r["dims"] for r in picked})}
        self.block_rows = block_rows
        self.blocks = keep(self._packed(rows).withColumn("block", F.monotonically_increasing_id()), "pivot-blocks")
        # a row for each pivot
        stats = self.blocks.groupBy("dims", "pivot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        self.stats = {(r["dims"], r["pivot"]): (r["n"], r["lo"], r["hi"]) for r in stats}

    def _packed(self, rows: DataFrame) -> DataFrame:
        """(dims, pivot, lo, hi, n, ids, vectors) of rows(id, v, dims): the nearest pivot's vectors by radius, a range of them to a task and block_rows to a block."""
        pivots, most = self.pivots, self.block_rows

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dims, part in pdf.groupby("dims"):
                    unit = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                    zero = ~unit.any(axis=1)
                    if dims in pivots:
                        chords = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots[dims].T))
                        pivot, r = chords.argmin(axis=1), chords.min(axis=1)
                    else:
                        pivot, r = np.full(len(part), -1), np.zeros(len(part))
                    yield pd.DataFrame({"dims": dims, "pivot": np.where(zero, -1, pivot), "r": np.where(zero, 0.0, r), "id": part["id"].to_numpy(), "v": [u.tobytes() for u in unit]})

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for pdf in batches:
                held = pdf if held is None else pd.concat([held, pdf])
                while len(held):
                    key = held.iloc[0][["dims", "pivot"]].tolist()
                    n = int(((held["dims"] == key[0]) & (held["pivot"] == key[1])).to_numpy()[:most].sum())
                    if n == len(held) and n < most:
                        break
                    yield block(held.iloc[:n])
                    held = held.iloc[n:]
            if held is not None and len(held):
                yield block(held)

        def block(part: pd.DataFrame) -> pd.DataFrame:
            first = part.iloc[0]
            return pd.DataFrame([{"dims": first["dims"], "pivot": first["pivot"], "lo": part["r"].min(), "hi": part["r"].max(), "n": len(part), "ids": part["id"].to_numpy(np.int64).tobytes(), "vectors": b"".join(part["v"])}])

        placed = rows.mapInPandas(assign, "dims int, pivot int, r double, id long, v binary")
        placed = placed.repartitionByRange("dims", "pivot", "r", "id").sortWithinPartitions("dims", "pivot", "r", "id")
        return placed.mapInPandas(pack, "dims int, pivot int, lo double, hi double, n int, ids binary, vectors binary")

    def _asked(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Blocks of queries(query_id, vector), and for each of them and each pivot the least and greatest chord between them: (q_block, dims, pivot, near, far, bound, first).

        bound is how near anything of the pivot can be; first marks the pivots, nearest first, that have k vectors together.
        """
        pivots, stats = self.pivots, self.stats
        rows = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("size(v) > 0").withColumn("dims", F.size("v"))
        blocks = keep(self._packed(rows).withColumn("q_block", F.monotonically_increasing_id()).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "n": "q_n"}), "pivot-queries")

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    unit = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dims"])
                    zero = not unit.any()
                    own = []
                    for (dims, pivot), (n, lo, hi) in stats.items():
                        if dims != row["dims"]:
                            continue
                        if zero or pivot < 0:
                            near = far = bound = RIGHT_ANGLE
                        else:
                            chords = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots[dims][pivot]))
                            near, far = chords.min(), chords.max()
                            bound = max(near - hi, lo - far, 0.0)
                        own.append((near, pivot, far, bound, n))
                    seen = 0
                    for near, pivot, far, bound, n in sorted(own):
                        out.append((row["q_block"], row["dims"], pivot, near, far, bound, seen < k, zero))
                        seen += n
                yield pd.DataFrame(out, columns=["q_block", "dims", "pivot", "near", "far", "bound", "first", "zero"])

        reach = blocks.select("q_block", "dims", "q_vectors").mapInPandas(bounds, "q_block long, dims int, pivot int, near double, far double, bound double, first boolean, zero boolean")
        return blocks, keep(reach, "pivot-reach")

    def _pairs(self, reach: DataFrame) -> DataFrame:
        """(q_block, block, n, bound) of reach's pivots and their blocks; bound is how near anything of the block can be."""
        meta = self.blocks.select("dims", "pivot", "block", "lo", "hi", "n")
        rows = reach.join(meta, ["dims", "pivot"])
        bound = F.when(F.col("zero") | (F.col("pivot") < 0), F.lit(RIGHT_ANGLE)).otherwise(F.greatest(F.col("near") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0)))
        return rows.withColumn("bound", bound)

    def _tile(self, blocks: DataFrame, block: str, n_tiles: int) -> Column:
        """The stretch, of n_tiles of about as many blocks, that a block of the written table blocks stands in; neighbours in the order of pivots and radii stand together."""
        task = F.shiftright(block, 33)
        # a row for each task that packed blocks; within it they were numbered one by one
        counts = {r[0]: r[1] for r in blocks.groupBy(task.cast("int")).agg(F.count("*")).collect()}
        ends = dict(zip(sorted(counts), np.cumsum([counts[t] for t in sorted(counts)]).tolist(), strict=True))
        if not ends:
            return F.lit(0)
        before = F.create_map(*[F.lit(x) for t in ends for x in (t, ends[t] - counts[t])])
        at = F.element_at(before, task.cast("int")) + F.col(block) - F.shiftleft(task, 33)
        return F.floor(at * F.lit(n_tiles) / F.lit(max(ends.values()))).cast("int")

    def _measured(self, pairs: DataFrame, asked: DataFrame, k: int | None, max_distance: float | None) -> DataFrame:
        """(q_block, query_id, doc_id, distance) of the written pairs(q_block, block): the k nearest of each query among those of its tile's blocks, or all, and none farther than max_distance.

        Blocks of queries and of the corpus lie in stretches, and a tile is a stretch of each. Every block is sent once to each tile where it meets one, not once for each block that
        it meets. A tile's queries are in memory while the corpus goes by, TILE_BYTES of them.
        """
        size = lambda df, n: df.agg(F.sum(F.col(n).cast("long") * F.col("dims") * 8)).first()[0] or 1
        q_bytes, c_bytes = size(asked, "q_n"), size(self.blocks, "n")
        most = int(np.sqrt(TILES))
        q_tiles = max(-(-q_bytes // TILE_BYTES), min(most, round(np.sqrt(TILES * q_bytes / c_bytes))), 1)
        c_tiles = max(-(-c_bytes // TILE_BYTES), TILES // q_tiles, 1)
        placed = pairs.select("q_block", "block", self._tile(asked, "q_block", q_tiles).alias("q_tile"), self._tile(self.blocks, "block", c_tiles).alias("c_tile"))
        own = [F.lit(0).alias("side"), F.col("q_block").alias("number"), "dims", F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), F.lit(None).cast("array<long>").alias("meets")]
        left = placed.select("q_tile", "c_tile", "q_block").distinct().join(asked.select("q_block", "dims", "q_ids", "q_vectors"), "q_block").select("q_tile", "c_tile", *own)
        # a tile has few blocks of queries, so the list of those that a block meets there is short
        meets = placed.groupBy("q_tile", "c_tile", "block").agg(F.collect_list("q_block").alias("meets"))
        right = meets.join(self.blocks.select("block", "dims", "ids", "vectors"), "block").select("q_tile", "c_tile", F.lit(1).alias("side"), F.col("block").alias("number"), "dims", "ids", "vectors", "meets")
        self.tiles = tiles = left.unionByName(right).withColumn("tile", F.col("q_tile") * c_tiles + F.col("c_tile")).drop("q_tile", "c_tile")

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tile, asked_here, best = None, {}, {}
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    if row["tile"] != tile:
                        yield from map(_frame, best.values())
                        tile, asked_here, best = row["tile"], {}, {}
                    ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
                    short = vectors.astype(np.float32)
                    if row["side"] == 0:
                        asked_here[row["number"]] = (ids, vectors, short)
                        continue
                    for number in row["meets"]:
                        q_ids, q, q_short = asked_here[number]
                        query, at, distance = _near(q, vectors, k, max_distance, q_short, short)
                        rows = (np.full(len(query), number), q_ids[query], ids[at], distance)
                        if k is None:
                            yield _frame(rows)
                        elif len(query):
                            best[number] = _best(rows if number not in best else tuple(map(np.concatenate, zip(best[number], rows, strict=True))), k)
            yield from map(_frame, best.values())

        dealt = tiles.repartition(int(q_tiles * c_tiles), "tile").sortWithinPartitions("tile", "side", "number")
        return dealt.mapInPandas(measure, "q_block long, query_id long, doc_id long, distance double")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, distance, rank): knn.nearest's result for queries(query_id, vector).

        First the nearest blocks that hold k vectors are read; the k-th distance there bounds what any other block must reach, and those that can are read then.
        """
        asked, reach = self._asked(queries, k)
        ahead = F.coalesce(F.sum("n").over(W.partitionBy("q_block").orderBy("bound", "near", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first = keep(self._pairs(reach.where("first")).withColumn("ahead", ahead).where(F.col("ahead") < k).select("q_block", "block"), "pivot-first")
        found = keep(self._measured(first, asked, k, None), "pivot-found")
        best = self._ranked(found, k).groupBy("q_block", "query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        reached = best.where(F.col("n") == k).groupBy("q_block").agg(F.count("*").alias("n_full"), F.max("kth").alias("kth"))
        limit = asked.select("q_block", "q_n").join(reached, "q_block", "left").select("q_block", F.when(F.col("n_full") == F.col("q_n"), F.sqrt(F.greatest(F.lit(2.0) * F.col("kth"), F.lit(0.0))) + SLACK).otherwise(F.lit(float("inf"))).alias("limit"))
        rest = self._pairs(reach.join(limit, "q_block").where(F.col("bound") <= F.col("limit"))).where(F.col("bound") <= F.col("limit"))
        rest = keep(rest.select("q_block", "block").join(first, ["q_block", "block"], "left_anti"), "pivot-rest")
        self.read = (first, rest)
        return self._ranked(found.unionByName(self._measured(rest, asked, k, None)), k).select("query_id", "doc_id", "distance", "rank")

    @staticmethod
    def _ranked(rows: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def within(self, queries: DataFrame, max_distance: float, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, distance) of all pairs that are max_distance apart at most; with k, of each query's k nearest such.

        With k no group of near vectors becomes pairs of all its members: a task hands on k of a query at most.
        """
        asked, reach = self._asked(queries, 1)
        limit = float(np.sqrt(max(2 * max_distance, 0))) + SLACK
        near = keep(self._pairs(reach.where(F.col("bound") <= limit)).where(F.col("bound") <= limit).select("q_block", "block"), "pivot-near")
        self.read = (near,)
        found = self._measured(near, asked, k, max_distance)
        return (found if k is None else self._ranked(found, k)).select("query_id", "doc_id", "distance")
