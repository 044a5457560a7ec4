"""Retrieval-quality measures over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(scored: DataFrame, score: str, tie: str, case: str = "case_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(case).orderBy(F.round(score, 9).desc(), tie)))


def recall_and_mrr(ranks: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """One row of ranks(case_id, rank, relevant): recall at each k and the mean reciprocal rank over the cases."""
    first = ranks.groupBy("case_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    hits = [F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("cases"), *hits, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def embedding_acceptance(cases: DataFrame, min_top1: float = 0.75, min_margin: float = 0.05) -> DataFrame:
    """One row of cases(case_id, relevant_similarity, distractor_similarity): top-1 accuracy, means, and whether both bars are met."""
    top1, margin = F.avg(F.when(F.col("relevant_similarity") > F.col("distractor_similarity"), 1.0).otherwise(0.0)), F.avg(F.col("relevant_similarity") - F.col("distractor_similarity"))
    out = cases.agg(top1.alias("top1"), margin.alias("margin"), F.avg("relevant_similarity").alias("relevant"), F.avg("distractor_similarity").alias("distractor"))
    return out.withColumn("accepted", (F.col("top1") >= min_top1) & (F.col("margin") >= min_margin))


def calibration(cases: DataFrame, threshold: float) -> DataFrame:
    """One row of cases(value, expected): accuracy of value <= threshold, ranges by label, and the middle of the gap between them."""
    yes, no = F.when(F.col("expected"), F.col("value")), F.when(~F.col("expected"), F.col("value"))
    out = cases.agg(F.count("*").alias("cases"), F.avg(F.when((F.col("value") <= threshold) == F.col("expected"), 1.0).otherwise(0.0)).alias("accuracy"), F.min(yes).alias("yes_min"), F.max(yes).alias("yes_max"), F.avg(yes).alias("yes_mean"), F.min(no).alias("no_min"), F.max(no).alias("no_max"), F.avg(no).alias("no_mean"))
    return out.withColumn("midpoint", (F.col("yes_max") + F.col("no_min")) / 2)


def two_stage(first: DataFrame, second: DataFrame, k: int = 3, min_top1: float = 0.75) -> DataFrame:
    """Recall at k of first(case_id, rank, relevant) and top-1 of second, which ranks first's k candidates anew."""
    a = first.groupBy("case_id").agg(F.max(((F.col("rank") <= k) & F.col("relevant")).cast("double")).alias("hit"))
    b = second.where("rank = 1").select("case_id", F.col("relevant").cast("double").alias("top"))
    out = a.join(b, "case_id", "left").agg(F.avg("hit").alias("recall"), F.avg(F.coalesce("top", F.lit(0.0))).alias("top1"))
    return out.withColumn("accepted", (F.col("recall") >= 1.0) & (F.col("top1") >= min_top1))
