"""The folder that all machines share, and intermediate tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in spark.checkpoint.dir. Where that is unset, a local master (tests, one machine) gets
    a temporary folder, once for each application; on a cluster that is an error, as its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the application's part of the shared folder and read it back.

    The result has no lineage above the files, so a lost executor costs no recomputation of what
    stands before it, and what reads it twice computes it once. Results are read from there lazily, so the
    folder, lodestack-<application id>, is for whoever runs the application to remove when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """df to be sent to every task if it has max_rows rows at most, else as it is; and which of both. df is a written table, so counting reads no more than that."""
    fits = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if fits else df), fits
