"""Which of many labels stand in a text: a multi-pattern automaton that reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The automaton is built in every task, so its patterns together have a bound: about a gigabyte of nodes.
MAX_PATTERN_CHARS = 8_000_000


def patterns_of(labels: DataFrame, max_chars: int = MAX_PATTERN_CHARS) -> list[tuple[str, str]]:
    """(label, pattern) of labels(label, pattern), distinct, checked against the bound before they come to the driver."""
    rows = labels.where("label is not null and pattern <> ''").distinct()
    chars = rows.agg(F.sum(F.length("pattern"))).first()[0] or 0
    if chars > max_chars:
        raise ValueError(f"patterns have {chars} characters, more than {max_chars}: search for parts of them in turn")
    return sorted((r["label"], r["pattern"]) for r in rows.collect())


def contained(rows: DataFrame, keys: list[str], text: Column, labels: DataFrame, max_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """(keys, label) of rows for each label with a pattern inside text: labels(label, pattern), equal to the letter.

    Patterns may overlap, or stand in each other; all that occur are found, and a label comes once for each row. Lower both sides for a comparison in any case. A null
    text, or one without a label, gives no row.
    """
    patterns = patterns_of(labels, max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, of = ahocorasick.Automaton(), {}
        for label, pattern in patterns:
            of.setdefault(pattern, []).append(label)
        for pattern, own in of.items():
            automaton.add_word(pattern, own)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            if of:
                for i, value in enumerate(batch.column(len(keys))):
                    seen = {label for _, own in automaton.iter(value.as_py() or "") for label in own}
                    at += [i] * len(seen)
                    found += sorted(seen)
            yield pa.RecordBatch.from_arrays([*batch.select(range(len(keys))).take(pa.array(at, pa.int64())).columns, pa.array(found, pa.string())], [*keys, "label"])

    picked = rows.select(*keys, text.cast("string").alias("text"))
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, label string")
