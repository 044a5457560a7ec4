"""Conversation prefix trie from mergeable partial tries.

A node of the trie is a sequence of turns from a conversation's beginning. It's named by its depth and a polynomial hash
of the sequence, which is a prefix sum over the conversation's turns: sums of stretches compose, so a
conversation may lie across many partitions. Each task combines the nodes of what it reads into a partial trie; partial
tries are merged in a tree, by the nodes' names, which adds up members and joins lists of ends. Sums over subtrees are
rolled up from the leaves at last.

The roll-up goes chain by chain. A node belongs to its smallest member; the nodes of one conversation are then a
chain, the last stretch of its path, that hangs from a node of another chain. A round settles all chains that no unsettled
chain hangs from and hands their sums to the nodes they hang from. So there are as many rounds as chains hang
from each other, which is never more than the depth and usually far less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import FAN_OUT, keep, starts
from lodestack.llm.mixing import WORD

#: A node's name: hashes modulo this prime to four bases, 124 bits in all.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 48_271_003, 1_597_334_677, 2_018_290_091)
ROOT = bytes(16)
#: Ends of a node are listed apart for each 1,024 consecutive conversation ids, so no list is longer.
BLOCK_BITS = 10
#: Partial tries that are merged at once, and rows that a task combines at once.
FAN_IN, ROWS = 16, 200_000
LEAD, FAMILY = 3, 20
LAST = (1 << 63) - 1


def powers(exponents: np.ndarray) -> np.ndarray:
    """BASES to each of the exponents, modulo PRIME: an array of a row for each."""
    out, base, left = np.ones((len(exponents), len(BASES)), np.uint64), np.array(BASES, np.uint64), exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * base % np.uint64(PRIME)
        base, left = base * base % np.uint64(PRIME), left >> np.uint64(1)
    return out


def lanes(digests: pa.Array) -> np.ndarray:
    """The four numbers of each 16-byte digest; a null digest is 0."""
    whole = b"".join(d or ROOT for d in digests.to_pylist())
    return np.frombuffer(whole, ">u4").astype(np.uint64).reshape(-1, 4) % np.uint64(PRIME)


def names(sums: np.ndarray) -> pa.Array:
    raw = sums.astype(">u4").tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def scanned(rows: DataFrame, order: list, name: str) -> tuple[DataFrame, dict[int, tuple]]:
    """rows(conv_id, ..., digest, words), sorted by conv_id and order, with prefix sums; and what each partition has to add.

    Columns: conv_id, digest, words, bucket (the partition), nth (from 0), sums and before (names of the turns up to this one and up to the one
    before it), all three counted within the partition. Ranges of the sort split a conversation that is large. The
    second result has (conv_id, rows, sums) for each partition whose first conversation began in an earlier one;
    one row a partition comes to the driver for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last, count, carry = TaskContext.get().partitionId(), None, 0, np.zeros(4, np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, x = batch.column("conv_id").to_numpy(), lanes(batch.column("digest"))
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            begin = np.repeat(first, np.diff(np.append(first, n)))
            nth, base = np.arange(n) - begin, np.zeros((n, 4), np.uint64)
            if conv[0] == last:
                stop = first[1] if len(first) > 1 else n
                nth[:stop] += count
                base[:stop] = carry
            terms = x * powers(nth) % np.uint64(PRIME)
            total = np.cumsum(terms, axis=0)
            sums = (base + total - total[begin] + terms[begin]) % np.uint64(PRIME)
            before = (sums + np.uint64(PRIME) - terms) % np.uint64(PRIME)
            last, count, carry = conv[-1], int(nth[-1]) + 1, sums[-1]
            yield pa.record_batch([batch.column("conv_id"), batch.column("digest"), batch.column("words"), pa.array(np.full(n, bucket, np.int32)), pa.array(nth), names(sums), names(before)], ["conv_id", "digest", "words", "bucket", "nth", "sums", "before"])

    ordered = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "digest", "words")
    placed = keep(ordered.mapInArrow(run, "conv_id long, digest binary, words long, bucket int, nth long, sums binary, before binary"), name)
    ends = placed.groupBy("bucket").agg(F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", "nth", "sums"), F.struct("conv_id", "nth")).alias("last")).orderBy("bucket").collect()
    out, state = {}, None
    for end in ends:
        conv, count, sums = end["last"]["conv_id"], end["last"]["nth"] + 1, lanes(pa.array([bytes(end["last"]["sums"])], pa.binary()))[0]
        if state and state[0] == end["first"]:
            out[end["bucket"]] = state
            if conv == end["first"]:
                sums = (state[2] + powers(np.array([state[1]]))[0] * sums) % np.uint64(PRIME)
                count += state[1]
        state = (conv, count, sums)
    return placed, out


def carried(batch: pa.RecordBatch, carries: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nth, sums and before of a batch of scanned rows, counted from their conversations' beginnings."""
    conv, bucket = batch.column("conv_id").to_numpy(), batch.column("bucket").to_numpy()
    nth, sums, before = batch.column("nth").to_numpy().copy(), lanes(batch.column("sums")), lanes(batch.column("before"))
    for b in np.unique(bucket):
        if int(b) in carries:
            first, count, base = carries[int(b)]
            at = np.flatnonzero((bucket == b) & (conv == first))
            shift = powers(np.array([count]))[0]
            nth[at] += count
            sums[at] = (base + shift * sums[at]) % np.uint64(PRIME)
            before[at] = (base + shift * before[at]) % np.uint64(PRIME)
    return nth, sums, before


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, words): the turns in order, null first, equal ones by role and the digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed, carries = scanned(rows.where("conv_id is not null"), [F.col("turn").asc_nulls_first(), "role", "digest"], "trie-turns")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("conv_id"), pa.array(carried(batch, carries)[0]), batch.column("digest"), batch.column("words")], ["conv_id", "nth", "digest", "words"])

    return placed.mapInArrow(number, "conv_id long, nth long, digest binary, words long")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): own turns(conv_id, nth, ...) with the first h turns taken from the family's first conversation; h comes
    from the id. A last row of each conversation, without a digest, marks its end, so one without turns has that row alone."""
    h = F.crc32(F.col("conv_id").cast("string")) % (LEAD + 1)
    own = keep(own, "trie-own")
    convs = keep(own.select("conv_id").distinct(), "trie-conversations")
    lead = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < LEAD)).withColumnRenamed("conv_id", "base")
    led = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lead, "base").where(F.col("nth") < h)
    rest = own.where(F.col("nth") >= h)
    end = convs.select("conv_id", F.lit(LAST).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return led.unionByName(rest, allowMissingColumns=True).select("conv_id", F.col("nth").alias("place"), "digest", "words").unionByName(end)


TRIE = "depth long, node binary, parent binary, words long, block long, conv_id long, n_convs long, ids array<long>, part int"


def partial_tries(sequences: DataFrame) -> DataFrame:
    """What each task combines of sequences(conv_id, place, digest, words): the nodes with their members and ends, for each block of ids."""
    placed, carries = scanned(sequences, ["place"], "trie-paths")

    def combine(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows, part = pa.concat_tables(parts), TaskContext.get().partitionId()
        keys = ["depth", "node", "block"]
        nodes = rows.filter(pc.invert(rows["end"])).group_by(keys).aggregate([("parent", "min"), ("words", "max"), ("conv_id", "min"), ("conv_id", "count")])
        ends = rows.filter(rows["end"]).group_by(keys).aggregate([("conv_id", "min"), ("conv_id", "list")])
        zeros = pa.array(np.zeros(ends.num_rows, np.int64))
        nodes = [nodes["depth"], nodes["node"], nodes["parent_min"], nodes["words_max"], nodes["block"], nodes["conv_id_min"], nodes["conv_id_count"], pa.array([[]] * nodes.num_rows, pa.list_(pa.int64()))]
        ends = [ends["depth"], ends["node"], pa.nulls(ends.num_rows, pa.binary()), zeros, ends["block"], ends["conv_id_min"], zeros, ends["conv_id_list"]]
        for columns in (nodes, ends):
            table = pa.table([*columns, pa.array(np.full(len(columns[0]), part, np.int32))], ["depth", "node", "parent", "words", "block", "conv_id", "n_convs", "ids", "part"])
            yield from table.combine_chunks().to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            nth, sums, before = carried(batch, carries)
            conv = batch.column("conv_id").to_numpy()
            end = batch.column("digest").is_null().to_numpy(zero_copy_only=False)
            # an end stands at the node of all turns before it, and makes its conversation a member of the root
            depth = np.where(end, nth, nth + 1)
            for at, d, node, parent, is_end in ((slice(None), depth, sums, before, end), (end, np.zeros(end.sum(), np.int64), sums[end] * np.uint64(0), before[end] * np.uint64(0), np.zeros(end.sum(), bool))):
                words = batch.column("words").to_numpy()[at]
                held.append(pa.table([pa.array(d), names(node), names(parent), pa.array(words), pa.array(conv[at] >> BLOCK_BITS), pa.array(conv[at]), pa.array(is_end)], ["depth", "node", "parent", "words", "block", "conv_id", "end"]))
            n += batch.num_rows
            if n >= ROWS:
                yield from combine(held)
                held, n = [], 0
        if held:
            yield from combine(held)

    return placed.mapInArrow(run, TRIE)


def merged(tries: DataFrame) -> DataFrame:
    """One row for each node and block of ids: partial tries of up to FAN_IN parts are merged by the nodes' names, again and again, until one is left."""
    tries = keep(tries, "trie-parts")
    most = (tries.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        ids = F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")
        tries = tries.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("depth", "node", "block", "part").agg(F.min("parent").alias("parent"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), ids)
        tries = keep(tries, "trie-merged")
        most = -(-most // FAN_IN)
        if most == 1:
            return tries.drop("part")


def end_digests(tries: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the nodes at which conversations end. The lists of a node go through its digest one by one, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (depth, node), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "node", "ends_sha256"])
        if at:
            yield pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.binary()), pa.array([digest.hexdigest()])], ["depth", "node", "ends_sha256"])

    lists = tries.where(F.size("ids") > 0).select("depth", "node", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return lists.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").select("depth", "node", "ids").mapInArrow(run, "depth long, node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes(depth, node, parent, words, conv_id, n_convs) with parent_conv_id, n_children, n_leaves and saved_tokens, from the leaves up."""
    saved = (F.col("n_convs") - 1) * F.col("words")
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("head"), F.max("depth").alias("tail"), F.min_by("parent", "depth").alias("up"), F.sum(saved).alias("saved"))
    above = nodes.select((F.col("depth") + 1).alias("head"), F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    chains = keep(chains.join(above, ["head", "up"], "left").drop("up"), "trie-chains")
    at_tail = chains.where("up_conv is not null").select(F.col("up_conv").alias("conv_id"), (F.col("head") - 1).alias("tail")).distinct().withColumn("more", F.lit(1))
    open_ = keep(chains.join(at_tail, ["conv_id", "tail"], "left").select("conv_id", "up_conv", (F.col("head") - 1).alias("up_depth"), "saved", F.when(F.col("more").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-open")
    handed = None
    while True:
        waiting = open_.where("up_conv is not null").select(F.col("up_conv").alias("conv_id")).distinct()
        ready = open_.join(waiting, "conv_id", "left_anti").where("up_conv is not null")
        given = keep(ready.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("more_children")), "trie-handed")
        if handed is not None and given.isEmpty():
            break
        # a node is handed something in several rounds where chains of different heights hang from it
        handed = given if handed is None else handed.unionByName(given)
        sums = given.groupBy("conv_id").agg(F.sum("more_saved").alias("s"), F.sum("more_leaves").alias("l"))
        open_ = keep(
            open_.join(waiting, "conv_id", "left_semi").join(sums, "conv_id", "left").select("conv_id", "up_conv", "up_depth", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")),
            "trie-open",
        )
    handed = handed.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("more_saved", "more_leaves", "more_children")])
    none = F.lit(0).cast("long")
    rows = nodes.join(chains.select("conv_id", "head", "tail", "up_conv"), "conv_id").join(handed, ["conv_id", "depth"], "left")
    inner = F.col("depth") < F.col("tail")
    rows = rows.select(
        "depth",
        "node",
        "conv_id",
        "n_convs",
        F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        (F.coalesce("more_children", none) + inner.cast("long")).alias("n_children"),
        (F.coalesce("more_leaves", none) + (~inner & F.col("more_children").isNull()).cast("long")).alias("leaves"),
        (saved + F.coalesce("more_saved", none)).alias("saved"),
        F.floor(F.col("depth") / FAN_OUT).cast("long").alias("stretch"),
    )
    # what stands below in the chain: in the same stretch of FAN_OUT depths, and in later ones
    below = W.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("n_leaves", F.sum("leaves").over(below)).withColumn("saved_tokens", F.sum("saved").over(below))
    stretches = (nodes.agg(F.max("depth")).first()[0] or 0) // FAN_OUT + 1
    if stretches > 1:
        rows = keep(rows, "trie-stretches")
        # counted from the last stretch on
        sums = keep(rows.groupBy("conv_id", (F.lit(stretches - 1) - F.col("stretch")).alias("bucket")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-stretch-sums")
        for value, total in (("leaves", "n_leaves"), ("saved", "saved_tokens")):
            later = starts(sums.select("conv_id", "bucket", value), ["conv_id"], value, stretches).select("conv_id", (F.lit(stretches - 1) - F.col("bucket")).alias("stretch"), F.col("start").alias("later"))
            rows = rows.join(later, ["conv_id", "stretch"]).withColumn(total, F.col(total) + F.col("later")).drop("later")
    return rows.drop("leaves", "saved", "stretch")


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each node of the trie of sequences(conv_id, place, digest, words), each conversation with an end row behind all others.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the ids of those that end at the
    node, ascending, joined by commas), and node, its name. Nodes are told apart by 124 bits. No rows give none. The digest of a node's ends is read by one
    task, a list at a time; all else of a node that many conversations share is combined before it is shuffled.
    """
    tries = merged(partial_tries(sequences))
    nodes = tries.groupBy("depth", "node").agg(F.min("parent").alias("parent"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nodes = keep(nodes, "trie-nodes")
    ends = keep(end_digests(tries), "trie-ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = rolled_up(nodes).join(ends, ["depth", "node"], "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "node")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of turns(conv_id, turn, role, text).

    A null role or text is empty; rows without a conv_id are left out, as they are nobody's turns; a repeated row is a turn each time; equal turns
    stand in order of role, then of the digest of role and text. Other columns, whatever their names, aren't read; no rows give none.
    """
    return trie(rebuilt(own_turns(turns.select("conv_id", "turn", "role", "text"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node")


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) - 1 AS nth FROM turns
), crc AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), sequences AS (
  SELECT c.conv_id, o.nth, o.role, o.text FROM crc c JOIN ordered o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.nth < c.h
  UNION ALL SELECT o.conv_id, o.nth, o.role, o.text FROM ordered o JOIN crc c USING (conv_id) WHERE o.nth >= c.h
), hashed AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(length(role) || ':' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS node
  FROM sequences WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), paths AS (
  SELECT conv_id, depth, words, md5(node) AS node FROM hashed UNION ALL SELECT conv_id, 0, 0, '' FROM crc
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
  SELECT node, p.depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l.depth = p.depth), '')) AS ends_sha256
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY node, p.depth
), linked AS (
  SELECT n.*, u.node AS up FROM nodes n LEFT JOIN paths u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1
), counted AS (
  SELECT l.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND c.up = l.node) AS n_children
  FROM linked l LEFT JOIN nodes p ON p.node = l.up AND p.depth = l.depth - 1
), below AS (
  SELECT p.node, p.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words)::BIGINT AS saved_tokens
  FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node, p.depth
)
SELECT conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted c JOIN below b ON b.node = c.node AND b.depth = c.depth
"""
