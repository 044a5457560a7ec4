"""The document library that the driver's tables stand for.

documents with labels are the library: approved is quality 1, access is public where toxic is 0, unlabelled documents are not
visible. Fields that the tables lack are functions of doc_id; regions and policy areas come from nation and region. `chunks` are
the pages of a document, 1,000 characters each. LIBRARY_SQL and CHUNKS_SQL say the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("uploaded", "ocr", "parsed", "annotated", "ready", "failed")
PAGE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # nation and region have 25 and 5 rows at any scale
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("country_region")))
    region = table(spark, sf_dir, "region")
    first, second = (F.broadcast(region.select(F.col("r_regionkey").cast("long").alias(k), F.col("r_name").alias(a))) for k, a in (("k1", "area1"), ("k2", "area2")))
    i = F.col("doc_id")
    rows = docs.join(labels, "doc_id", "left").withColumns({"nk": i % 25, "k1": i % 5, "k2": F.floor(i / 5) % 5}).join(nation, "nk", "left").join(first, "k1", "left").join(second, "k2", "left")
    return rows.select(
        "doc_id",
        "text",
        F.col("lang").alias("language"),
        F.col("source").alias("source_organisation"),
        F.col("n_chars").alias("file_size"),
        F.concat(F.lit("doc-"), i.cast("string"), pick((".pdf", ".docx", ".txt", ".md"), i % 4)).alias("original_filename"),
        F.when(i % 3 != 0, F.concat(F.lit("Title "), F.substring("text", 1, 40))).alias("title"),
        F.substring("text", 1, 200).alias("summary"),
        pick(("report", "policy", "web", "guide"), i % 4).alias("source_type"),
        "country_region",
        F.when(i % 7 != 0, (F.lit(1995) + i % 30).cast("int")).alias("year"),
        F.array_distinct(F.array("area1", "area2")).alias("policy_areas"),
        F.array("lang", "source").alias("keywords"),
        pick(STATUSES, i % 6).alias("status"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("approved"),
        F.when(F.col("toxic") == 0, "public").otherwise("restricted").alias("access_level"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(i % 1000).cast("int"))).alias("uploaded_at"),
        F.ceil(F.length("text") / PAGE).cast("long").alias("page_count"),
    )


LIBRARY_SQL = """
library AS (
  SELECT d.doc_id, d.text, d.lang AS language, d.source AS source_organisation, d.n_chars AS file_size,
    'doc-' || d.doc_id || ['.pdf', '.docx', '.txt', '.md'][d.doc_id % 4 + 1] AS original_filename,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'Title ' || left(d.text, 40) END AS title, left(d.text, 200) AS summary,
    ['report', 'policy', 'web', 'guide'][d.doc_id % 4 + 1] AS source_type, n.n_name AS country_region,
    CASE WHEN d.doc_id % 7 <> 0 THEN (1995 + d.doc_id % 30)::INTEGER END AS year,
    CASE WHEN r1.r_name = r2.r_name THEN [r1.r_name] ELSE [r1.r_name, r2.r_name] END AS policy_areas,
    [d.lang, d.source] AS keywords, ['uploaded', 'ocr', 'parsed', 'annotated', 'ready', 'failed'][d.doc_id % 6 + 1] AS status,
    coalesce(l.quality = 1, false) AS approved, CASE WHEN l.toxic = 0 THEN 'public' ELSE 'restricted' END AS access_level,
    TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 1000)::INTEGER) AS uploaded_at, ceil(length(d.text) / 1000.0)::BIGINT AS page_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 25
  LEFT JOIN region r1 ON r1.r_regionkey = d.doc_id % 5 LEFT JOIN region r2 ON r2.r_regionkey = (d.doc_id // 5) % 5
)"""


def visible():
    """What users who aren't administrators may see."""
    return F.col("approved") & (F.col("access_level") == "public")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text) of docs(doc_id, text): the whole text in pages of 1,000 characters."""
    pages = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PAGE).cast("int") - 1, F.lit(0)))
    rows = docs.where("text is not null and text <> ''").select("doc_id", "text", F.explode(pages).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.expr(f"substring(text, chunk_index * {PAGE} + 1, {PAGE})").alias("text"))


CHUNKS_SQL = """
chunks AS (
  SELECT doc_id, k::INTEGER AS chunk_index, substring(text, k * 1000 + 1, 1000) AS text
  FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS k FROM documents WHERE text <> '')
)"""
