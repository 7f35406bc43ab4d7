"""Ordered positions inside groups of any size.

A plain window puts a whole group into one task.  Here the rows are range
partitioned on (keys, order), so a large group spans many tasks, and a
window over one subtotal per (group, partition) supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.session import materialize, shuffle_partitions


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, out: str) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the same keys that come earlier.

    The rows must be unique in (keys, order).  Null keys form a group of
    their own.  An empty input gives an empty result.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    placed = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed)
    sums = placed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = local.join(sums, on)
    return joined.withColumn(out, F.col("_before") + F.col("_offset")).select(*df.columns, out)


def competition_ranks(df: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str], out: str) -> DataFrame:
    """Add `out`: 1 plus the number of rows of the same keys with a greater value.

    Equal values share a rank.  A null value counts as the lowest of its
    group, so it shares the rank of the lowest value, or rank 1 where every
    value is null.  The rows must be unique in (keys, unique).  Neither a
    group nor a run of equal values is gathered: both are cut where the range
    partitions end, and only what stands at those ends is compared.
    """
    spark = df.sparkSession
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col(value).desc_nulls_last()] + [F.col(u).asc() for u in unique]
    placed = materialize(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_r", F.rank().over(Window.partitionBy(*keys, "_part").orderBy(F.col(value).desc_nulls_last())))
    v = F.col(value)
    ends = local.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max(v).alias("_high"), F.min(v).alias("_low"), F.max(F.when(v.isNotNull(), F.col("_r"))).alias("_low_r"))
    group = Window.partitionBy(*keys)
    ends = ends.withColumn("_ahead", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # where a partition begins amid equal values, the first partition that ends with them knows their rank
    first = ends.filter(F.col("_low").isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_low").alias("_v")).agg(F.min(F.col("_ahead") + F.col("_low_r")).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ends = ends.join(first, [*same, F.col("_high") == F.col("_v")], "left").select(*keys, "_part", "_ahead", "_high", "_low", "_low_r", F.least(F.col("_ahead") + 1, F.coalesce("_first", F.col("_ahead") + 1)).alias("_begin"))
    low = F.when(F.col("_low") == F.col("_high"), F.col("_begin")).otherwise(F.col("_ahead") + F.col("_low_r"))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_ahead", "_begin", F.coalesce(F.max(low).over(group), F.lit(1)).alias("_lowest"))
    rank = F.when(v.isNull(), F.col("_lowest")).when(F.col("_r") == 1, F.col("_begin")).otherwise(F.col("_ahead") + F.col("_r"))
    return local.join(ends, [*same, F.col("_part") == F.col("_p")]).select(*df.columns, rank.cast("long").alias(out))
