"""Running sums and last values within groups, however large a group is: a segmented prefix scan in two levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.storage import keep


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with, under each name of sums, the sum so far and, of lasts, the last value that isn't null, both with the row's own; within equal `by`, in order.

    Rows are sorted by ranges of `by` and order together, so a large group lies in several ranges. Windows stand within a range of a group; what the ranges before it add comes from
    a row for each range and group. order should tell the rows of a group apart, and a null in `by` counts as a value.
    """
    sums, lasts = sums or {}, lasts or {}
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # a written table: its ranges are the same however often it's read
    placed = keep(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "running-rows")
    within = W.partitionBy(*by, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    own = placed.withColumns({**{n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}, **{n: F.last(c, ignorenulls=True).over(within) for n, c in lasts.items()}})
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_{n}") for n, c in lasts.items()]
    ranges = placed.groupBy(*by, "_range").agg(*totals)
    # as many rows in a window as a group has ranges
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("_range").alias("_before"), *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums], *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in lasts])
    before = before.where(reduce(lambda a, b: a | b, [F.col(f"_{n}").isNotNull() for n in [*sums, *lasts]]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by], F.col("_range") == F.col("_before"))
    out = own.join(before, same, "left")
    return out.select(*rows.columns, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums], *[F.coalesce(n, f"_{n}").alias(n) for n in lasts])
