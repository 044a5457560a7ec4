"""New states of tables: upserts, patches, governance, replacement, cascade. Each returns the whole new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALWAYS_NEW = ("stakeholders", "implementation_risks", "metadata_json")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key; the others stay."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def merge_generated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A reviewed row keeps its own values that are neither null nor an empty array; all else takes the new ones."""
    fields = [c for c in old.columns if c not in (key, "reviewed_at")]
    arrays = {f.name for f in old.schema.fields if f.dataType.typeName() == "array"}
    both = old.alias("o").join(new.alias("n"), key, "full")

    def value(c):
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
        present = mine.isNotNull() & (F.size(mine) > 0) if c in arrays else mine.isNotNull()
        keeps = F.lit(False) if c in ALWAYS_NEW else F.col("o.reviewed_at").isNotNull() & present
        untouched = F.col("__new").isNull()
        return F.when(keeps | untouched, mine).otherwise(theirs).alias(c)

    both = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), key, "full")
    return both.select(key, *[value(c) for c in fields], F.col("o.reviewed_at").alias("reviewed_at"))


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null scalars and non-empty arrays of changes replace; the rest stays. Only rows of old."""
    types = {f.name: f.dataType.typeName() for f in old.schema.fields}
    given = [c for c in changes.columns if c != key]
    both = old.alias("o").join(changes.alias("c"), key, "left")
    out = [F.coalesce(F.when(F.size(F.col(f"c.{c}")) > 0, F.col(f"c.{c}")) if types[c] == "array" else F.col(f"c.{c}"), F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c) for c in old.columns if c != key]
    return both.select(key, *out)


def register_imports(governance: DataFrame, imports: DataFrame, now: str, interval_days: int = 30) -> DataFrame:
    """State after imports(doc_id): a new row is active; a known one is fetched now, reviewed one interval later, its error cleared, its status unchanged."""
    t = F.lit(now).cast("timestamp_ntz")
    both = governance.join(imports.select("doc_id", F.lit(True).alias("__hit")).distinct(), "doc_id", "full")
    days = F.coalesce("refresh_interval_days", F.lit(interval_days))
    hit = F.coalesce("__hit", F.lit(False))
    return both.select(
        "doc_id",
        F.coalesce("lifecycle_status", F.lit("active")).alias("lifecycle_status"),
        days.alias("refresh_interval_days"),
        F.when(hit, t).otherwise(F.col("last_fetched_at")).alias("last_fetched_at"),
        F.when(hit, t + F.make_dt_interval(days=days)).otherwise(F.col("next_review_at")).alias("next_review_at"),
        F.when(~hit, F.col("last_refresh_error")).alias("last_refresh_error"),
    )


def patch_governance(governance: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """State after changes(doc_id, lifecycle_status, refresh_interval_days, next_review_at), nulls meaning no change.

    A given review time wins; else a given interval sets it from now; else it stays. approved_override is false for rows that are archived by this.
    """
    t = F.lit(now).cast("timestamp_ntz")
    both = governance.alias("g").join(changes.alias("c"), "doc_id", "left")
    return both.select(
        "doc_id",
        F.coalesce("c.lifecycle_status", "g.lifecycle_status").alias("lifecycle_status"),
        F.coalesce("c.refresh_interval_days", "g.refresh_interval_days").alias("refresh_interval_days"),
        "g.last_fetched_at",
        F.coalesce("c.next_review_at", t + F.make_dt_interval(days=F.col("c.refresh_interval_days")), F.col("g.next_review_at")).alias("next_review_at"),
        "g.last_refresh_error",
        F.when(F.col("c.lifecycle_status") == "archived", F.lit(False)).alias("approved_override"),
    )


def due_for_review(governance: DataFrame, now: str, status: str | None = None) -> DataFrame:
    due = governance.where(F.col("next_review_at") <= F.lit(now).cast("timestamp_ntz"))
    return due.where(F.col("lifecycle_status") == status) if status else due


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are replaced."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade_delete(deleted: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    return [t.join(deleted.select(key).distinct(), key, "left_anti") for t in tables]


def unique_owner(docs: DataFrame, value: str, order) -> DataFrame:
    """Only the first row of equal values keeps it; it is null in the others."""
    rank = F.row_number().over(W.partitionBy(value).orderBy(*order))
    return docs.withColumn("__rank", F.when(F.col(value).isNotNull(), rank)).withColumn(value, F.when(F.col("__rank") == 1, F.col(value))).drop("__rank")


def union_in_order(rows: DataFrame, by: list[str], key: list[str], position: str) -> DataFrame:
    """The first of rows with equal key within `by`, in order of position."""
    w = W.partitionBy(*by, *key).orderBy(position)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def invite_state(now: str):
    """used before revoked before expired before active."""
    return F.when(F.col("consumed_at").isNotNull(), "used").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"), "expired").otherwise("active")
