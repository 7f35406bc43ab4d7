"""Fusion of ranked lists and of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def rrf(lists: Sequence[tuple[str, DataFrame]], k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """(query_id, id, rrf_score, rank, retrieved_by): named lists of (query_id, id, rank, score) fused by the sum of 1 / (k + rank).

    Null ids are skipped.  Ties go to the item met first (list order, then
    rank, then id).  k <= 0 raises; top_k of None or <= 0 sets no limit.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = [df.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.lit(i).alias("pos"), F.lit(name).alias("source")) for i, (name, df) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.filter(F.col("id").isNotNull())
    sums = both.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.min(F.struct("pos", "rank")).alias("first"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("retrieved_by"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 12).desc(), "first", "id")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    if top_k and top_k > 0:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "id", F.round("raw", 6).alias("rrf_score"), "rank", "retrieved_by")


def fuse_evidence(vector: DataFrame, graph: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, id, source, retrieved_by, vector_rank, graph_rank) of what either branch found and the caller may see.

    An item of both branches counts once, as hybrid_graph_vector.  Where the
    graph branch has facts, they come along.
    """
    more = ["facts"] if "facts" in graph.columns else []
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank")).dropDuplicates(["query_id", "id"])
    g = graph.select("query_id", "id", F.col("rank").alias("graph_rank"), *more).dropDuplicates(["query_id", "id"])
    both = v.join(g, ["query_id", "id"], "full_outer").join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
    has_v, has_g = F.col("vector_rank").isNotNull(), F.col("graph_rank").isNotNull()
    source = F.when(has_v & has_g, "hybrid_graph_vector").when(has_v, "vector").otherwise("graph")
    by = F.array_join(F.array_compact(F.array(F.when(has_v, F.lit("vector")), F.when(has_g, F.lit("graph")))), ",")
    return both.select("query_id", "id", source.alias("source"), by.alias("retrieved_by"), "vector_rank", "graph_rank", *more)


def fusion_stats(fused: DataFrame) -> DataFrame:
    """Per query: items of either branch, of both, and altogether, after access control."""
    v, g = F.col("vector_rank").isNotNull(), F.col("graph_rank").isNotNull()
    return fused.groupBy("query_id").agg(F.count_if(v).alias("vector_count"), F.count_if(g).alias("graph_count"), F.count_if(v & g).alias("overlap_count"), F.count(F.lit(1)).alias("fused_count"))


def rank_migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, initial_rank, final_rank, migration) of what both rankings hold."""
    b = before.select("query_id", "id", F.col("rank").alias("initial_rank"))
    return b.join(after.select("query_id", "id", F.col("rank").alias("final_rank")), ["query_id", "id"]).withColumn("migration", F.col("initial_rank") - F.col("final_rank"))
