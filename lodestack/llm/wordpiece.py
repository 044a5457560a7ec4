"""Token counts by a linear longest-match automaton.

A trie of the vocabulary with failure links: where no child fits, the link leads to where greedy matching would stand
after it has taken what it can, and the node knows how many tokens that pops. One pass over the bytes of a word counts its greedy pieces
without building any.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe
from lodestack.llm.common import documents


class LongestMatch:
    """first: the pieces that may open a word; later: those that may follow, by default the same ones."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        self.child: dict[int, int] = {}
        self.is_token, self.parent_edges = [False], [[]]
        self.root = self.again = 0
        if later is not None:
            self.again = self._node()
        self._insert(self.root, first)
        if later is not None:
            self._insert(self.again, later)
        self._link()

    def _node(self) -> int:
        self.is_token.append(False)
        self.parent_edges.append([])
        return len(self.is_token) - 1

    def _insert(self, root: int, pieces: Iterable[bytes]) -> None:
        for piece in pieces:
            node = root
            for c in piece:
                key = node << 8 | c
                if key not in self.child:
                    self.child[key] = new = self._node()
                    self.parent_edges[node].append((c, new))
                node = self.child[key]
            if piece:
                self.is_token[node] = True

    def _link(self) -> None:
        """Breadth first: a link leads to a node that is less deep, so it is known already. -1: greedy matching fails."""
        n = len(self.is_token)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque(dict.fromkeys([self.root, self.again]))
        while queue:
            u = queue.popleft()
            for c, v in self.parent_edges[u]:
                if self.is_token[v]:
                    self.fail[v], self.pops[v] = self.again, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z << 8 | c) not in self.child:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.child[z << 8 | c], popped
                queue.append(v)
        del self.parent_edges

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word; 1, the unknown token, if they don't cover it; 0 for an empty one."""
        node, total, child, fail, pops = self.root, 0, self.child, self.fail, self.pops
        if not word:
            return 0
        for c in word:
            while (found := child.get(node << 8 | c)) is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = found
        while node != self.again:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class TokenCounter:
    """Counts of whole texts: white space and letters fall into pretokens, each is matched by itself; frequent ones are looked up."""

    def __init__(self, path: str):
        self.automaton = LongestMatch(bpe.ByteBpe(path).tokens)
        self.fine = regex.compile(bpe.FINE)
        self.words = bpe.Memo(lambda word: sum(self.automaton.count(p.encode("utf-8", "surrogatepass")) for p in self.fine.findall(word)))

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, bpe.COARSE.findall(text)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens for docs(doc_id, text): greedy longest-match pieces of the vocabulary in the file.

    Null and empty texts have 0 tokens. Every row is counted by itself, whatever its doc_id, its repeats or other columns; an empty table
    gives no rows.
    """
    path = path or public_tokenizers.path(bpe.DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.count(t) for t in bpe.texts_of(batch.column(1))], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
