"""Token ids packed into rows of a fixed length by best-fit-decreasing with a segment-tree search.

Documents are encoded, cut losslessly into pieces of a row's length at most, and packed in bounded blocks as tasks stream
their partitions: no shuffle, and a task holds one block. A row has its ids, the cumulative lengths of its segments,
the position of each id within its segment, and which document and offset each segment comes from.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe
from lodestack.llm.bpe import texts_of
from lodestack.llm.common import documents

ROW_TOKENS = 2048
BLOCK_TOKENS = 4_000_000
#: The first id beyond the vocabulary, whose last is the end-of-text token.
PAD = 50257
DEFAULT = "byte_bpe_50k.tiktoken"
LONG_RUN = 4000
SPACE_RUN = re.compile(f"[{bpe.SPACE}]{{{LONG_RUN}}}")
OUT = "row_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, doc_offsets array<long>"
BINARY = OUT.replace(" ids array<int>", " ids binary").replace("position_ids array<int>", "position_ids binary")
WIDTHS = {2: "<u2", 4: "<u4"}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, merges: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file, loaded once for each Python worker, with the special tokens of the same vocabulary's merges file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=bpe.tokenizer(merges).special)


def encoded(text: str, fast: tiktoken.Encoding, merges: str) -> np.ndarray:
    """The ids of a text, special tokens in it among them: those of bpe.encode().

    The rank encoder fails on very long runs of white space; a text that has one goes to the merge encoder, whose ids are the same.
    """
    if len(text) > LONG_RUN and SPACE_RUN.search(text):
        return np.frombuffer(bpe.tokenizer(merges).encode(text), "<i4")
    return np.array(fast.encode(text, allowed_special="all"), np.int32)


class CapacityTree:
    """Rows by free capacity; a segment tree over capacities finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a row with the least free capacity of at least need, removed; None if there is none."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes whose lengths add up to capacity at most. Lengths fall; equal ones keep their order."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(i)
        if free > lengths[i]:
            tree.put(free - lengths[i], row)
    return rows


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], capacity: int, pad: int, first: int, width: int | None) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(ids) for _, _, ids in pieces], capacity)
    ids = np.full((len(rows), capacity), pad, np.int32)
    positions = np.zeros((len(rows), capacity), np.int32)
    count = np.arange(capacity, dtype=np.int32)
    used, ends, doc_ids, offsets = [], [], [], []
    for r, members in enumerate(rows):
        at, cuts = 0, [0]
        for i in members:
            n = len(pieces[i][2])
            ids[r, at : at + n] = pieces[i][2]
            positions[r, at : at + n] = count[:n]
            at += n
            cuts.append(at)
        used.append(at)
        ends.append(cuts)
        doc_ids.append([pieces[i][0] for i in members])
        offsets.append([pieces[i][1] for i in members])

    def matrix(values: np.ndarray) -> pa.Array:
        if width is None:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * capacity), pa.array(values.ravel()))
        if values.size and (values.min() < 0 or values.max() >= 1 << 8 * width):
            raise ValueError(f"ids or positions don't fit {width} bytes")
        return pa.array([row.tobytes() for row in values.astype(WIDTHS[width])], pa.binary())

    columns = [
        pa.array(np.arange(first, first + len(rows))), pa.array(used, pa.int32()), matrix(ids), pa.array(ends, pa.list_(pa.int32())),
        matrix(positions), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64())),
    ]
    return pa.record_batch(columns, [x.split()[0] for x in OUT.split(", ")])


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad: int = PAD, path: str | None = None, merges: str | None = None, width: int | None = None) -> DataFrame:
    """Packed rows of the tokens of docs(doc_id, text). path is a rank file, merges the same vocabulary with its merges.

    ids has row_tokens ids, the last of them `pad` beyond n_tokens. With a width, ids and position_ids are little-endian unsigned binary of so
    many bytes each, for loaders that map files; ids that don't fit are an error. cu_seqlens starts with 0 and ends with n_tokens; segment k is a
    run of document doc_ids[k] from token doc_offsets[k] on; position_ids starts at 0 in each segment and is 0 in the padding.
    A document of more than row_tokens fills rows by itself and its last piece is packed. Null and empty texts
    have no tokens and are in no row. A null doc_id stands as null; rows that repeat a doc_id are packed each. row_id holds the
    partition above 33 bits and counts below. An empty table gives no rows.
    """
    path, merges = path or public_tokenizers.path(DEFAULT), merges or public_tokenizers.path(bpe.DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces, held, next_id = tokenizer(path, merges), [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = encoded(text, own, merges)
                for at in range(0, len(ids), row_tokens):
                    pieces.append((doc_id, at, ids[at : at + row_tokens]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        out = _packed(pieces, row_tokens, pad, next_id, width)
                        pieces, held, next_id = [], 0, next_id + out.num_rows
                        yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))
        if pieces:
            out = _packed(pieces, row_tokens, pad, next_id, width)
            yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT if width is None else BINARY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), width=2)
