"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Each source has a weight and a rate r(t) over training time t in [0, 1]. The integral of the rate says
which share of the source's target has been asked for by t. A document copy that starts after c words
of its source is therefore wanted at the t at which the integral reaches c / target: inverting the
cumulative demand gives its training position. Documents are range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import documents, fresh, keep, merged, sent, starts

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: For each weight the knots (t, rate) of a piecewise linear schedule: the first source fades, the second is even, the third grows.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))
MAX_REPEATS = 3
ROWS_PER_BUCKET = 400


def inverted(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The t at which the schedule's integral, scaled to 1 at the end, reaches share."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(areas), 0.0, None
    for k, ((t0, r0), (t1, r1)) in enumerate(zip(knots, knots[1:], strict=False)):
        q = F.greatest(share * F.lit(total) - F.lit(before), F.lit(0.0))
        slope = (r1 - r0) / (t1 - t0)
        # the root of slope/2 x^2 + r0 x = q, in the form that also holds for slope 0
        x = F.lit(t0) + F.lit(2.0) * q / (F.lit(r0) + F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2.0 * slope) * q, F.lit(1e-12))))
        before += areas[k]
        last = k == len(areas) - 1
        out = F.when(share * F.lit(total) <= F.lit(before), x) if out is None and not last else x if out is None else out.otherwise(x) if last else out.when(share * F.lit(total) <= F.lit(before), x)
    return F.least(out, F.lit(1.0))


def _ranked(per: DataFrame) -> DataFrame:
    """per(source, ...) with `nth`, counting from 0 by code point, null last: places within sorted ranges, plus the ranges before."""
    ranges = per.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(ranges.withColumn("id", F.monotonically_increasing_id()).withColumns({"bucket": part, "row": row}).drop("id"), "mix-ranked")
    sizes = placed.groupBy(F.lit(0).alias("all"), "bucket").agg(F.count("*").alias("n"))
    last = placed.agg(F.max("bucket")).first()[0]
    before = starts(sizes, ["all"], "n", (last or 0) + 1)
    return placed.join(merged(before), "bucket").withColumn("nth", F.col("start") + F.col("row")).drop("bucket", "row", "all", "start")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, turn) for sizes(source, size); turn indexes weights.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at
    max_repeats times its source's size and the excess is reshared by weight until none is above: each round one aggregate finds
    the level, words per weight, that the sources below their limit get, until no further source reaches its limit.
    """
    per = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    per = per.withColumn("turn", (F.col("nth") % len(weights)).cast("int"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    per = keep(per, "mix-sources")
    level = 0.0
    while True:
        free = F.col("cap") / F.col("w") >= F.lit(level)
        sums = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, F.col("cap"))).alias("met"), F.sum(F.when(free, F.col("w"))).alias("w")).first()
        new = (sums["all"] - (sums["met"] or 0.0)) / sums["w"] if sums["w"] else level
        if new <= level:
            break
        level = new
    return per.select("source", "source_size", F.round(F.least("cap", F.lit(level) * F.col("w")), 6).alias("target"), "turn")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each of docs(doc_id, text, source): how much of it the mix takes, and when.

    Columns: doc_id, source, size (words, null text 0), source_size, target, taken, copies, positions, position.
    A source's documents stand in the order of md5(doc_id) and are read round and round until the
    target, rounded to a word, is met; the last copy is cut there, so the words taken of a source add up to it. copies
    counts whole copies (half or more of the last counts). positions are the copies' training times in [0, 1],
    position is the first; null if nothing is taken. Rows with equal doc_id in a source stand in order of size; equal in
    both, they get the same or adjoining ranges in either order. Null doc_ids stand first. An empty table gives no rows.

    The running sum is made of short windows, however large a source is: rows within a hash bucket, and sums of buckets level by level. The
    number of buckets follows from the number of rows.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("place"))
    rows = keep(rows, "mix-sizes")
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET + 1, 16)))
    rows = rows.withColumn("bucket", F.coalesce(F.conv(F.substring("place", 1, digits), 16, 10).try_cast("long"), F.lit(0)))
    per_bucket = keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    begin = keep(starts(per_bucket, ["source"], "size", 16**digits), "mix-starts")
    targets = keep(source_targets(per_bucket, weights, max_repeats), "mix-targets")
    begin = keep(begin.alias("s").join(sent(targets).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "start", "source_size", "target", "turn"), "mix-plans")
    within = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size")
    rows = rows.withColumn("run", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.alias("r").join(sent(begin).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    rows = rows.select("doc_id", "r.source", "size", "source_size", "target", "turn", (F.col("start") + F.col("run")).alias("at"))
    budget = F.round("target").cast("long")
    parts = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("at") - F.lit(e) * F.col("source_size"))) for e in range(max_repeats)]
    rows = rows.withColumn("taken", sum(parts[1:], parts[0]))
    n_copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0)) + F.lit(0.5))).otherwise(F.lit(0)).cast("int")

    def placed(turn: int) -> Column:
        shares = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: (F.col("at") + e * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)))
        return F.transform(shares, lambda q: F.round(inverted(schedules[turn], q), 6))

    positions = placed(len(schedules) - 1)
    for turn in range(len(schedules) - 1):
        positions = F.when(F.col("turn") % len(schedules) == turn, placed(turn)).otherwise(positions)
    rows = rows.withColumn("copies", n_copies).withColumn("positions", F.when(F.col("taken") > 0, F.slice(positions, F.lit(1), F.greatest(F.col("copies"), F.lit(1)))))
    rows = rows.withColumn("position", F.get("positions", F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix orders them, each as often as it has copies, range-sorted by the copies' positions; columns as they were.

    Rows that repeat a doc_id share the plan of one of them; so do rows without a doc_id.
    """
    own, at = fresh(docs, "mix_id", "mix_at")
    plan = mix(docs.select("doc_id", "text", "source")).where("copies > 0").select(F.col("doc_id").alias(own), F.slice("positions", F.lit(1), F.col("copies")).alias(at))
    plan = keep(plan.groupBy(own).agg(F.max(at).alias(at)), "mix-plan")
    rows = docs.join(merged(plan), F.col("doc_id").eqNullSafe(F.col(own))).withColumn(at, F.explode(at))
    return rows.orderBy(at, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source", "positions")


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS place FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (turn + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE level <= cap / w
), targets AS (
  SELECT source, source_size, turn, round(least(cap, coalesce((SELECT level FROM settled) * w, cap)), 6) AS target FROM weighed
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.turn,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS run
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (greatest(0, least(size, round(target)::BIGINT - run)) + greatest(0, least(size, round(target)::BIGINT - run - source_size))
             + greatest(0, least(size, round(target)::BIGINT - run - 2 * source_size)))::BIGINT AS taken, run / nullif(target, 0) AS q FROM placed
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN size > 0 THEN floor(taken / size::DOUBLE + 0.5) ELSE 0 END::INTEGER AS copies,
       CASE WHEN taken > 0 THEN round(least(1.0, CASE turn
         WHEN 0 THEN 2 * q / (1.5 + sqrt(greatest(1.5 * 1.5 - 2 * q, 1e-12)))
         WHEN 1 THEN 2 * q / (1 + sqrt(1.0))
         ELSE CASE WHEN q * 0.9375 <= 0.3125 THEN 2 * q * 0.9375 / (0.5 + sqrt(0.25 + q * 0.9375))
              ELSE 0.5 + 2 * (q * 0.9375 - 0.3125) / (0.75 + sqrt(0.5625 + 4 * (q * 0.9375 - 0.3125))) END END), 6) END AS position
FROM taken
"""
