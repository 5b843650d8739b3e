"""Ranking helpers that never hold a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# No window holds more rows of one group than this, unless the last level of bins is reached.
GROUP_ROWS = 200_000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key.  Spark prunes each map task to k rows per key before the shuffle, for k up to the session's
    `spark.sql.optimizer.windowGroupLimitThreshold`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; keeps the left key columns."""
    names = {k: f"_right_{k}" for k in keys}
    condition = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), condition, how).drop(*names.values())


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in `order` (ascending, not null).  A plain aggregate, so hot keys are
    reduced on the map side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def newest(ts: Column) -> Column:
    """Ascending sort key that puts the newest time first and nulls last."""
    return F.coalesce(-F.unix_micros(ts), F.lit((1 << 63) - 1))


def full_rank(df: DataFrame, keys: Sequence[str], levels: Sequence[Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row per key, for keys of any size.

    Each level is a bin that grows with `order`: rows of a lower bin come first.  Rows are numbered inside their bin
    and shifted by the size of the lower bins; a bin with more than GROUP_ROWS rows is divided by the next level."""
    bin_name = f"_bin{len(keys)}"
    binned = df.withColumn(bin_name, levels[0])
    group = [*keys, bin_name]
    before = Window.partitionBy(*keys).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)
    sizes = binned.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    placed = join_on_keys(binned, offsets, group)

    def finish(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, (F.col("_offset") + F.col("_inner")).cast("int")).select(*df.columns, name)

    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    if len(levels) == 1 or sizes.where(F.col("_size") > GROUP_ROWS).isEmpty():
        return finish(placed.withColumn("_inner", number))
    crowded = placed.where(F.col("_size") > GROUP_ROWS).withColumnRenamed("_offset", f"_base{len(keys)}").drop("_size")
    inner = full_rank(crowded, group, levels[1:], order, "_inner").withColumnRenamed(f"_base{len(keys)}", "_offset")
    return finish(placed.where(F.col("_size") <= GROUP_ROWS).withColumn("_inner", number)).unionByName(finish(inner))


def running_min(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """Minimum of `value` over the rows of the same key that come earlier in `order`, for keys of any size.

    The minimum of all earlier bins is added to the running minimum inside the bin; levels divide crowded keys as in
    `full_rank`."""
    crowded_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not levels or crowded_keys.where(F.col("_size") > GROUP_ROWS).isEmpty():
        return df.withColumn(name, F.min(value).over(window))
    sized = join_on_keys(df, crowded_keys, keys)
    plain = sized.where(F.col("_size") <= GROUP_ROWS).drop("_size").withColumn(name, F.min(value).over(window))
    bin_name, bin_before = f"_bin{len(keys)}", f"_before{len(keys)}"
    group = [*keys, bin_name]
    binned = sized.where(F.col("_size") > GROUP_ROWS).drop("_size").withColumn(bin_name, levels[0])
    earlier = Window.partitionBy(*keys).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*group).agg(F.min(value).alias("_m")).select(*group, F.min("_m").over(earlier).alias(bin_before))
    inner = join_on_keys(running_min(binned, group, value, levels[1:], order, name), bins, group)
    split = inner.withColumn(name, F.least(name, bin_before)).select(*df.columns, name)
    return plain.unionByName(split)


def within_quota(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str = "admitted") -> DataFrame:
    """Flag the first `limit` rows per key and keep all rows.  The cut-off of each key comes from a pruned
    top-k, so the rows beyond the quota are compared with it and never sorted together."""
    sort_key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    cut = (
        top_k(df.select(*keys, sort_key.alias("_key")), keys, [F.col("_key")], limit, "_rank")
        .groupBy(*keys).agg(F.max("_key").alias("_cut"))
    )
    return join_on_keys(df, cut, keys).withColumn(name, sort_key <= F.col("_cut")).drop("_cut")
