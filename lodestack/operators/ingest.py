"""The ingest of documents as one plan: hash, pages, language, chunks, vectors, status and error of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import heuristic_language, normalised_hash
from lodestack.operators import etl, models


def processed(extracted: DataFrame, known: DataFrame | None = None, budget: int = 480, overlap: int = 60, embedder: models.Factory | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of extracted(doc_id, pages, error), rows of an extractor.

    documents: doc_id, status, error, content_hash, language, page_count, duplicate_of. A document that failed, has no text, or repeats the text of
    known(doc_id, content_hash) gets no chunks. chunks: those of etl.chunk, with embedding where an embedder is given.
    """
    text = F.array_join(F.transform(F.coalesce("pages", F.from_json(F.lit("[]"), "array<struct<page:int,text:string>>")), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    docs = extracted.withColumn("text", text).withColumn("content_hash", F.when(F.trim("text") != "", normalised_hash(F.col("text"))))
    if known is None:
        docs = docs.withColumn("duplicate_of", F.lit(None).cast("long"))
    else:
        owners = known.groupBy("content_hash").agg(F.min("doc_id").alias("duplicate_of"))
        docs = docs.join(owners, "content_hash", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.trim("text") == "", "failed").otherwise("ready")
    error = F.coalesce("error", F.when(F.trim("text") == "", F.lit("no extractable text")))
    documents = docs.select("doc_id", status.alias("status"), error.alias("error"), "content_hash", heuristic_language(F.col("text")).alias("language"), F.coalesce(F.size("pages"), F.lit(0)).alias("page_count"), "duplicate_of")
    ready = docs.where(F.col("error").isNull() & (F.trim("text") != "") & F.col("duplicate_of").isNull())
    chunks = etl.chunk(ready, budget, overlap)
    if embedder is not None:
        chunks = chunks.withColumn("embedding", models.embed(F.col("text"), embedder))
    return documents, chunks


def reembedded(chunks: DataFrame, documents: DataFrame, embedder: models.Factory, model_id: str) -> DataFrame:
    """Vectors of a further model for the chunks of ready documents, to be appended to the vectors partitioned by model_id."""
    ready = documents.where("status = 'ready'").select("doc_id")
    return chunks.join(ready, "doc_id", "left_semi").select("doc_id", "chunk_index", F.lit(model_id).alias("model_id"), models.embed(F.col("text"), embedder).alias("embedding"))


def rescanned(files: DataFrame, registered: DataFrame) -> DataFrame:
    """Status rows after a full rescan: new files are registered, and all are queued again; files(path, sha256), registered(path, sha256)."""
    new = files.join(registered.select("path"), "path", "left_anti").join(registered.select("sha256").distinct(), "sha256", "left_anti").select("path", "sha256")
    return registered.select("path", "sha256").unionByName(new).withColumn("status", F.lit("uploaded"))
