"""Incremental sinks as joins: insert-or-ignore, upsert, guarded update, seed upgrade, candidate append.

Each function returns the rows to write; writing is left to the caller (`append` for new rows, a staged
overwrite for whole tables), so that no table format is required."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.operators.ranking import first_per_key


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows whose key is new; the first row in `order` wins inside the batch."""
    return first_per_key(incoming, keys, order).join(target.select(*keys), list(keys), "left_anti")


def split_known(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows with `is_new`; in-batch repeats of a new key count once as new elsewhere (insert_ignore)."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return incoming.join(known, list(keys), "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], mutable: Sequence[str]) -> DataFrame:
    """Whole table after an upsert: existing rows take only the mutable columns, new rows take everything.
    `updates` holds one row per key."""
    t, u = target.withColumn("_t", F.lit(True)).alias("t"), updates.withColumn("_u", F.lit(True)).alias("u")
    joined = t.join(u, list(keys), "full_outer")
    def pick(column: str) -> Column:
        if column in keys:
            return F.col(column)
        old, new = F.col(f"t.{column}"), F.col(f"u.{column}")
        use_new = F.col("_u").isNotNull() if column in mutable else F.col("_t").isNull()
        return F.when(use_new, new).otherwise(old).alias(column)
    return joined.select(*[pick(c) for c in target.columns])


def update_newer(target: DataFrame, results: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Apply the latest result per key unless the stored row is newer (a missing stored time counts as oldest)."""
    latest = results.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, *columns)).alias("_v"), F.max(time).alias("_at"))
    joined = target.join(latest, key, "left")
    take = F.col("_at").isNotNull() & (F.col(time).isNull() | (F.col(time) <= F.col("_at")))
    new = {c: F.when(take, F.col("_v")[c]).otherwise(F.col(c)) for c in columns} | {time: F.when(take, F.col("_at")).otherwise(F.col(time))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in target.columns])


def seed_upgrade(existing: DataFrame, seed: DataFrame, unique: Sequence[str], stored_version: str | None, version: str) -> DataFrame:
    """Existing rows plus the seed rows that collide with none of the unique columns; a no-op when the stored
    version is current."""
    if stored_version == version:
        return existing
    missing = seed
    for column in unique:
        missing = missing.join(existing.select(column), column, "left_anti")
    return existing.unionByName(missing.select(*existing.columns))


def candidate_append(queued: DataFrame, incoming: DataFrame, cap: int | None = None) -> DataFrame:
    """New (job, url) candidates: one per canonical address (smallest source id), not queued yet.  A job whose
    total would pass the cap, if one is given, is refused as a whole and flagged."""
    fresh = incoming.groupBy("job_id", "url").agg(F.min("source_id").alias("source_id")).join(
        queued.select("job_id", "url"), ["job_id", "url"], "left_anti")
    if cap is None:
        return fresh.select("job_id", "url", "source_id", F.lit(True).alias("accepted"))
    totals = queued.select("job_id", F.lit(0).alias("new")).unionByName(fresh.select("job_id", F.lit(1).alias("new"))).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"))
    return fresh.join(totals, "job_id").select("job_id", "url", "source_id", (F.col("total") <= cap).alias("accepted"))
