"""Exact nearest neighbours by cosine for a table of queries, in blocks.

Queries and corpus are packed into blocks of rows; every block pair is one matrix product that keeps the k best of each
query, and the blocks' best are ranked. No pair of rows is materialised, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.storage import keep

BLOCK_ROWS = 4096


def _packed(rows: DataFrame, id_col: str, vector: str, block_rows: int, scope: str | None = None) -> DataFrame:
    """(scope, dims, ids, vectors): up to block_rows rows of a partition and scope as binary; rows without a vector, or with a null scope, are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list[pd.DataFrame]] = {}

        def block(key: tuple[str, int]) -> pd.DataFrame:
            part = pd.concat(held.pop(key))
            return pd.DataFrame([{"scope": key[0], "dims": key[1], "ids": part["id"].to_numpy(np.int64).tobytes(), "vectors": np.stack(part["v"].to_numpy()).astype(np.float64).tobytes()}])

        for pdf in batches:
            for key, part in pdf.groupby([pdf["scope"], pdf["v"].map(len)]):
                held.setdefault(key, []).append(part)
                if sum(map(len, held[key])) >= block_rows:
                    yield block(key)
        for key in list(held):
            yield block(key)

    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    within = F.lit("") if scope is None else F.col(scope).cast("string")
    rows = usable.select(within.alias("scope"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("scope is not null")
    return rows.mapInPandas(pack, "scope string, dims int, ids binary, vectors binary")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, max_distance: float | None = None, block_rows: int = BLOCK_ROWS, scope: str | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank) of queries(query_id, vector) and corpus(doc_id, vector).

    The distance is 1 - cosine in double, 1 for a zero vector. Equal distances, to 9 decimals, rank by doc_id. A query with
    fewer than k candidates of its dimensions gets those; one without a vector gets none. With scope, a column of both sides,
    a query meets the rows of its own scope only, and gets the k nearest of those.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                q, c = (np.frombuffer(row[n], np.float64).reshape(-1, row["dims"]) for n in ("q_vectors", "vectors"))
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
                distance = 1 - np.divide(q @ c.T, scale, out=np.zeros_like(scale), where=scale > 0)
                rounded, most = np.round(distance, 9), min(k, len(ids)) - 1
                # all that are no farther than the k-th; only those are put in order
                query, at = np.nonzero(rounded <= np.partition(rounded, most, axis=1)[:, most : most + 1])
                order = np.lexsort((ids[at], rounded[query, at], query))
                query, at = query[order], at[order]
                first = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, at = query[first], at[first]
                out = pd.DataFrame({"query_id": q_ids[query], "doc_id": ids[at], "distance": distance[query, at]})
                yield out if max_distance is None else out[out["distance"] <= max_distance]

    # packed and written once; pairs of block numbers meet on scope and dimensions, then fetch their blocks
    left = keep(_packed(queries, "query_id", "vector", block_rows, scope).withColumn("left_id", F.monotonically_increasing_id()), "knn-queries").withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    right = keep(_packed(corpus, "doc_id", "vector", block_rows, scope).withColumn("right_id", F.monotonically_increasing_id()), "knn-corpus")
    pairs = left.select("scope", "dims", "left_id").join(right.select("scope", "dims", "right_id"), ["scope", "dims"]).select("left_id", "right_id")
    pairs = pairs.join(left.select("left_id", "q_ids", "q_vectors"), "left_id").join(right.select("right_id", "dims", "ids", "vectors"), "right_id")
    candidates = pairs.mapInPandas(best, "query_id long, doc_id long, distance double")
    order = W.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
