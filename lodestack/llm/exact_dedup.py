"""Exact dedup over a persistent digest index, bucketed and sorted by hash.

New data is reduced to one row per digest, anti-joined with the index by sort-merge and appended to
it. Index and batch are both laid out by the digest's hash into the same number of parts, so the
index is never shuffled. DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import fresh, keep, merged, shared_dir


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest.

    name: the table's name. path: where its files are (by default below the shared folder).
    n_buckets: fixed when the table is made; by default the session's number of shuffle partitions, so
    that an aggregate by digest is already laid out like the buckets and each task writes one file.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, n_buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.n_buckets} BUCKETS LOCATION '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups(digest, ...) whose digest isn't in the index."""
        return groups.join(merged(self.table().select("digest")), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep_id").write.format("parquet").bucketBy(self.n_buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, rows: DataFrame) -> DataFrame:
        """Decide on a batch rows(doc_id, text) and record what is new.

        Returns doc_id, keep_id, group_size, kept, text_sha256 for every row. A text that the index
        holds already keeps its holder; of equal new texts the largest doc_id stays. group_size counts the
        batch's rows of that text. Null text counts as empty. Rows that repeat a doc_id and its text
        share one verdict; so do the rows of a text that has only null doc_ids: keep_id null, kept.
        An empty batch gives no rows and adds none.
        """
        digests = keep(rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "digests")
        groups = keep(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        self.append(self.unseen(groups))
        holders = keep(groups.drop("keep_id").join(merged(self.table()), "digest"), "digest-holders")
        return digests.join(merged(holders), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Verdicts for docs(doc_id, text); other columns, whatever their names, aren't read."""
    return (index or DigestIndex(docs.sparkSession)).deduplicate(docs.select("doc_id", "text"))


def keep_distinct_texts(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops, and one row of those that repeat a doc_id and its text; columns as they were."""
    # a null doc_id counts as one value; the key columns are those of both the reduction and the join, so rows are dealt out once
    names = fresh(docs, "id", "no_id", "digest")
    own, none, digest = names
    key = [F.coalesce("doc_id", F.lit(0)).alias(own), F.col("doc_id").isNull().alias(none)]
    kept = exact_dedup(docs, index).where("kept").select(*key, F.col("text_sha256").alias(digest)).distinct()
    rows = docs.select("*", *key, F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest)).dropDuplicates(names)
    return rows.join(merged(kept), names, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
