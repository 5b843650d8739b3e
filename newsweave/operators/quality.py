"""Declarative row checks, uniqueness and reference checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add `violations`: the names of the rules a row breaks, in rule order.  An unknown result is a violation."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.filter(F.array(*broken), lambda v: v.isNotNull()))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = with_violations(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose reference points to no parent; null references are allowed."""
    ids = parents.select(F.col(parent_key or key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(ids, key, "left_anti")
