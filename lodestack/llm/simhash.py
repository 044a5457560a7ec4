"""SimHash near-dedup by anchor-point covering.

Two fingerprints of 64 bits that differ in 3 bits at most differ in one bit at most in the low or in the
high half. Over 31 bits of each half the anchors are the words of the Hamming code [31, 26], whose
covering radius is 1: every value is within 1 of exactly one anchor, its home. A value within 1 of
another is within radius plus threshold = 2 of the other's home. So each fingerprint goes once to its home
and once to each anchor within 2 (1 or 16 of them), and fingerprints are compared per anchor, over all 64 bits. No
pair is missed, and a pair meets in a few anchors at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lodestack.llm.common import connected_components, documents, fresh, keep, merged, sent

SHINGLE = 3
THRESHOLD = 3
HALF_BITS = 31
HOMES_PER_BLOCK, ROWS_PER_BLOCK = 500, 2000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles as a signed integer; 0 if it has no word.

    A-Z are lower-cased, words end at the ASCII white space characters that bytes.split() knows. A text of fewer words
    than a shingle is one shingle. A bit is 1 if more than half of the shingles' hashes, repeats counted, have it.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxh64_digest(b" ".join(words), 42)
    else:
        joined = b" ".join(words)
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
        starts = np.append(0, ends[:-1] + 1)
        digests = b"".join([xxh64_digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    lanes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * bits > len(lanes)).tobytes(), "big", signed=True)


#: Row b holds the 8 bits of byte b, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest and fp (signed long) of docs(doc_id, text); digest is the text's SHA-256, null as empty. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fp = [fingerprint(x.as_py(), shingle) for x in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, fp long")


def _codewords_near() -> list[list[int]]:
    """For each syndrome s, the masks that turn a value of that syndrome into the anchors within 2 of it; the first is its home."""
    out = []
    for s in range(HALF_BITS + 1):
        home = [1 << (s - 1)] if s else [0]
        pairs = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in itertools.combinations(range(1, HALF_BITS + 1), 2) if i ^ j == s] if s else []
        out.append(home + pairs)
    return out


def _syndrome(value: Column) -> Column:
    """The xor of the positions, from 1, of the bits that are set: 0 for words of the Hamming code."""
    masks = [sum(1 << (p - 1) for p in range(1, HALF_BITS + 1) if p >> k & 1) for k in range(5)]
    parts = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), k) for k, m in enumerate(masks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out.cast("int")


def with_anchors(fps: DataFrame) -> DataFrame:
    """Rows (half, anchor, home, fp, ...): fps(fp, ...) at every anchor within 2, home marking the one within 1."""
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in _codewords_near()])
    low = F.lit((1 << HALF_BITS) - 1)
    halves = F.array(*[F.struct(F.lit(h).alias("half"), F.shiftright(F.col("fp"), 32 * h).bitwiseAND(low).alias("value")) for h in (0, 1)])
    rows = fps.withColumn("h", F.explode(halves)).withColumn("masks", F.element_at(table, _syndrome(F.col("h.value")) + 1))
    rows = rows.select("*", F.posexplode("masks").alias("nth", "mask"))
    return rows.select("h.half", F.col("h.value").bitwiseXOR(F.col("mask")).alias("anchor"), (F.col("nth") == 0).alias("home"), *fps.columns)


def _crowded_links(group: pd.DataFrame, threshold: int = THRESHOLD) -> pd.DataFrame:
    """Of one bounded block of an anchor: each linked row with the smallest rep that it reaches inside the block."""
    x, y = group[group["home"]], group
    a, b = x["fp"].to_numpy().view(np.uint64), y["fp"].to_numpy().view(np.uint64)
    rx, ry = x["rep"].to_numpy(), y["rep"].to_numpy()
    linked = np.vstack([np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= threshold for k in range(0, len(a), 256)]) if len(a) else np.zeros((0, len(b)), bool)
    top = np.iinfo(np.int64).max
    left, right = rx.copy(), ry.copy()
    while True:
        new = np.minimum(left, np.where(linked, right, top).min(1, initial=top))
        new_right = np.minimum(right, np.where(linked, new[:, None], top).min(0, initial=top))
        if (new == left).all() and (new_right == right).all():
            break
        left, right = new, new_right
    out = pd.DataFrame({"a": np.concatenate([rx, ry]), "b": np.concatenate([left, right])})
    return out[out["a"] != out["b"]].drop_duplicates()


def links(fps: DataFrame, threshold: int = THRESHOLD, crowded: int = 100) -> DataFrame:
    """Edges (a, b) between reps of fps(fp, rep) that join all fingerprints at threshold or fewer differing bits.

    An anchor with up to `crowded` home fingerprints is an equi-join: its pairs grow with the rows that reach it, not with
    their square. Homes and rows of an anchor with more are dealt to blocks of their own, every block of homes against every block of rows, and a pair of blocks
    returns edges that connect what is linked in it, at most one for each row. No pair goes unseen.
    """
    if threshold > 3:
        raise ValueError("anchors within radius 1 + 1 of a half cover 3 differing bits at most")
    rows = with_anchors(fps)
    homes = rows.where("home")
    hot = keep(homes.groupBy("half", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("half", "anchor"), "simhash-crowded")
    hot = sent(hot)
    calm = homes.join(hot, ["half", "anchor"], "left_anti").alias("x").join(merged(rows).alias("y"), ["half", "anchor"])
    calm = calm.where((F.col("x.fp") != F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= threshold)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    dealt = rows.join(hot, ["half", "anchor"])
    sizes = dealt.groupBy("half", "anchor").agg(F.ceil(F.count_if("home") / HOMES_PER_BLOCK).cast("int").alias("home_blocks"), F.ceil(F.count("*") / ROWS_PER_BLOCK).cast("int").alias("row_blocks"))
    dealt = dealt.join(sent(keep(sizes, "simhash-blocks")), ["half", "anchor"])

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    as_home = dealt.where("home").select("half", "anchor", "home", "fp", "rep", block("home_blocks").alias("i"), every("row_blocks").alias("j"))
    as_row = dealt.select("half", "anchor", F.lit(False).alias("home"), "fp", "rep", every("home_blocks").alias("i"), block("row_blocks").alias("j"))
    busy = as_home.unionByName(as_row).groupBy("half", "anchor", "i", "j").applyInPandas(lambda g: _crowded_links(g, threshold), "a long, b long")
    return calm.unionByName(busy)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, digest, fp, component and component_id for every row of docs(doc_id, text); other columns, whatever their names, aren't read.

    component is the smallest fingerprint of the component, the same for all its rows and for no others.
    component_id is the smallest doc_id reachable over links of at most `threshold` differing bits, the row itself
    included. Rows without a doc_id get their fingerprint, link with nothing and have component_id null. Null,
    empty and word-less texts have fingerprint zero and link like any other. Repeated rows share all values; a doc_id
    that stands at different texts joins nothing by that. Equal fingerprints are one row in all that follows the first aggregate,
    so copies cost nothing there. Tables with a row for each fingerprint meet by shuffles; none is sent through the driver. An empty table gives no rows.
    """
    fps = keep(fingerprints(docs, shingle), "simhash")
    distinct = keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp", F.col("fp").alias("rep")), threshold), "simhash")
    placed = keep(distinct.join(merged(parts), distinct["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-parts")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = keep(placed.join(merged(least), "component").select("fp", "component", "component_id"), "simhash-ids")
    return fps.join(merged(ids), "fp", "left").select("doc_id", "digest", "fp", "component", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id, and of its texts in the component that of the smallest digest.

    Rows without a doc_id stay. Rows that repeat the doc_id and the text of the document that stays all stay. Columns as they were.
    """
    own, digest = fresh(docs, "id", "digest")
    found = keep(near_duplicates(docs.select("doc_id", "text")), "simhash-found")
    stays = found.where("doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.*")
    dropped = found.where("doc_id is not null").join(merged(stays), ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    of_text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.join(merged(dropped), (docs["doc_id"] == F.col(own)) & (of_text == F.col(digest)), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
