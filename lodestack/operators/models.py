"""Models from outside as columns: embedders, rerankers, token counters, detectors.

Each takes a function over a batch; it is made once for each Python worker by a factory, which loads what it needs there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[list[str]], list]]


def embed(text: Column, factory: Factory, batch: int = 32) -> Column:
    """Vectors of texts, array<float>; the function gets up to `batch` texts at a time. A null text has no vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            given = texts.dropna()
            out = []
            for k in range(0, len(given), batch):
                out += [list(map(float, v)) for v in model(given.iloc[k : k + batch].tolist())]
            if len(out) != len(given):
                raise ValueError("the model returned another number of vectors than it got texts")
            vectors = iter(out)
            yield pd.Series([next(vectors) if known else None for known in texts.notna()], index=texts.index, dtype=object)

    return run(text)


def rerank_score(question: Column, text: Column, factory: Callable[[], Callable[[list[str], list[str]], list]]) -> Column:
    """Scores of question and text pairs; a missing one counts 0."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            yield pd.Series([0.0 if s is None else float(s) for s in model(q.fillna("").tolist(), t.fillna("").tolist())], index=q.index)

    return run(question, text)


def counted(text: Column, factory: Factory) -> Column:
    """Token counts, 1 at least."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([max(1, int(n)) for n in model(texts.fillna("").tolist())], index=texts.index)

    return run(text)


def vector_table(model: str, dims: int) -> str:
    """The table, or partition, of a model's vectors."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", f"chunk_vectors_{model}_{dims}".lower()).strip("_")[:63]
