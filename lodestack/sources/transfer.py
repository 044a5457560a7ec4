"""Catalogue transfer as JSON: a header line with format and version, then rows; import upserts and never deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.state import upsert

FORMAT, VERSION = "model-catalogue", 1
SECRETS = ("api_key", "password", "secret", "token")


def export_rows(rows: DataFrame, path: str) -> None:
    """Write rows as JSON without columns that hold secrets."""
    public = rows.select(*[c for c in rows.columns if c.lower() not in SECRETS])
    public.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.struct(*public.columns).alias("row")).write.mode("overwrite").json(path)


def import_rows(spark: SparkSession, path: str, current: DataFrame, key: list[str]) -> DataFrame:
    """current with the file's rows upserted; the job fails on another format or version. Columns that the file lacks keep their value."""
    public = [c for c in current.columns if c.lower() not in SECRETS]
    types = {f.name: f.dataType.simpleString() for f in current.schema.fields}
    raw = spark.read.schema(f"format string, version int, row struct<{','.join(f'`{c}`:{types[c]}' for c in public)}>").json(path)
    ok = F.assert_true((F.col("format") == FORMAT) & (F.col("version") == VERSION), F.lit("not a catalogue of this format and version"))
    new = raw.where(ok.isNull()).select("row.*")
    hidden = [c for c in current.columns if c not in public]
    if hidden:
        new = new.join(current.select(*key, *hidden), key, "left")
    return upsert(current, new.select(*current.columns), key)
