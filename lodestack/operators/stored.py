"""Tables that keep what is written to them: hash partitions, of which a change rewrites those that it touches, and a manifest that is written last.

    <path>/rows/<write>/partition=<p>/   the rows of a partition, as of that write
    <path>/manifest/                     a row for each version: which write each partition stands in

Readers take the newest version's row. A change writes its partitions beside the old ones and then publishes them with one row, so one that breaks off, wherever, leaves the
version before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.operators import state

MANIFEST = "version int, n_partitions int, writes map<string,string>"


class StoredTable:
    """The table at path, of schema, with columns key that tell rows apart; one writer at a time. n_partitions is set when it is made."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], n_partitions: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        now = self.manifest()
        self.n_partitions = now["n_partitions"] if now else n_partitions

    def manifest(self) -> Row | None:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").orderBy(F.col("version").desc()).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def writes(self) -> dict[int, str]:
        """Which write each partition with rows stands in."""
        now = self.manifest()
        return {int(p): w for p, w in now["writes"].items()} if now else {}

    def _partition(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n_partitions)).cast("int")

    def rows(self, partitions: list[int] | None = None) -> DataFrame:
        """The table, or some of its partitions: only their directories are listed."""
        paths = [f"{self.path}/rows/{w}/partition={p}" for p, w in sorted(self.writes().items()) if partitions is None or p in partitions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put merge(old rows, changes) in the place of the partitions that the keys of changes fall in; returns those. Other partitions are neither read nor written."""
        touched = sorted(r[0] for r in changes.select(self._partition()).distinct().collect())
        if touched:
            self._put(merge(self.rows(touched), changes), touched)
        return touched

    def _put(self, rows: DataFrame, partitions: list[int]) -> None:
        write, now = uuid.uuid4().hex, self.manifest()
        placed = rows.select(*self.schema.fieldNames()).withColumn("partition", self._partition())
        placed.repartition("partition").write.partitionBy("partition").parquet(f"{self.path}/rows/{write}")
        # a partition without rows has no directory
        filled = {r["partition"] for r in self.spark.read.schema("partition int").parquet(f"{self.path}/rows/{write}").distinct().collect()}
        writes = {p: w for p, w in self.writes().items() if p not in partitions} | {p: write for p in partitions if p in filled}
        self._publish(1 + (now["version"] if now else 0), writes)

    def _publish(self, version: int, writes: dict[int, str]) -> None:
        self.spark.createDataFrame([(version, self.n_partitions, {str(p): w for p, w in writes.items()})], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def upsert(self, rows: DataFrame) -> list[int]:
        return self.change(rows, lambda old, new: state.upsert(old, new.select(*old.columns), self.key))

    def insert_missing(self, rows: DataFrame) -> list[int]:
        return self.change(rows, lambda old, new: state.insert_missing(old, new.select(*old.columns), self.key))

    def patch(self, changes: DataFrame) -> list[int]:
        """state.patch, for a key of one column."""
        return self.change(changes, lambda old, new: state.patch(old, new, self.key[0]))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys.select(*self.key), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def replace(self, rows: DataFrame) -> list[int]:
        """The whole table anew."""
        everything = list(range(self.n_partitions))
        self._put(rows, everything)
        return everything


def cascade(keys: DataFrame, key: str, tables: list[StoredTable]) -> None:
    """Delete the rows of keys(key) from tables that key tells apart or begins the keys of; children first, so that what breaks off leaves no orphans.

    A child's rows of a key may lie in several partitions, so its keys are looked up first.
    """
    for table in reversed(tables):
        table.delete(table.rows().join(keys.select(key), key, "left_semi").select(*table.key))
