"""Per-key results when a few keys hold most of the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: Sequence[str], first: Mapping[str, Column], merge: Mapping[str, str], fan_in: int = 8) -> DataFrame:
    """Aggregate by keys in rounds of at most `fan_in` partial states per key and task.

    Round 0 combines each input partition by itself: the partition's number is
    part of the key, so a hot key leaves one state per partition and no task
    sees its rows.  Each further round divides that number by fan_in and
    merges, until one state per key is left: log(partitions) to the base
    fan_in rounds, in none of which one task receives all partials.  `first`
    has the aggregates of round 0, `merge` for each how two states combine
    (sum, min or max).  Null keys form a group.  An empty input gives no rows.
    """
    parts = max(1, df.rdd.getNumPartitions())
    state = df.withColumn("_slot", F.spark_partition_id()).groupBy(*keys, "_slot").agg(*[c.alias(n) for n, c in first.items()])
    rounds = max(1, math.ceil(math.log(parts, fan_in))) if parts > 1 else 1
    for i in range(rounds):
        # the last round takes what is left, also if the plan had more partitions than were counted
        slot = F.floor(F.col("_slot") / fan_in).cast("int") if i + 1 < rounds else F.lit(0)
        state = state.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(*[MERGE[merge[n]](n).alias(n) for n in first])
    return state.drop("_slot")


def edge_ends(edges: DataFrame) -> DataFrame:
    """(side, entity_id): both ends of every edge, from one scan."""
    return edges.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_entity_id").alias("entity_id")), F.struct(F.lit("target").alias("side"), F.col("target_entity_id").alias("entity_id")))).alias("e")).select("e.side", "e.entity_id")


def edges_per_side(edges: DataFrame) -> DataFrame:
    """(side, entity_id, n_edges) for every entity that stands on that side; null ids are counted under null."""
    return tree_aggregate(edge_ends(edges), ["side", "entity_id"], {"n_edges": F.count(F.lit(1))}, {"n_edges": "sum"})


def heavy_ends(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(side, entity_id) with at least `share` of all rows on that side.

    The two side totals are merged from the per-key states.  Rows whose id is
    null count in the totals but are not reported.
    """
    per = edges_per_side(edges)
    total = per.groupBy("side").agg(F.sum("n_edges").alias("total"))  # two rows
    return per.join(F.broadcast(total), "side").filter(F.col("entity_id").isNotNull() & (F.col("n_edges") >= F.lit(share) * F.col("total"))).select("side", "entity_id")


#: Keys that hold at least one row in so many are hot, so there are at most so many of them.
HOT = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """Rows joined with `classes`, which has one row for each of their keys and in `size` how many rows have it.

    Hot keys, of which there are at most HOT, are joined by broadcast, so that
    no task gathers their rows; the others by a shuffle.  Null keys match
    nothing.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(2, total / HOT)
    few = F.broadcast(classes.filter(hot))
    rest = rows.join(few.select(*keys), list(keys), "left_anti").join(classes.filter(~hot), list(keys))
    return rows.join(few, list(keys)).unionByName(rest)
