"""One ranking from scores of unlike scales: reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ranking import competition_ranks
from skein.session import materialize
from skein.sources.tables import table

K = 60


def fuse_scores(items: DataFrame, group: str, item: str, scores: Sequence[str], newest: str | None = None, k: int = K) -> DataFrame:
    """(group, item, rank_<score> per score, fused): fused is the sum of 1 / (k + rank) over the scores.

    Only ranks count, so no score's range matters.  Equal scores share a
    rank; a missing score (null or NaN) counts as the lowest of its group.
    An item that stands in a group more than once counts once, with the row
    that is newest by `newest`, then greatest by its scores.  Rows with a
    null group or item are dropped.  The ranks come from range partitions, so
    one group, or one score within it, may hold any share of the rows.
    """
    known = [F.when(F.isnan(F.col(s)), None).otherwise(F.col(s).cast("double")).alias(s) for s in scores]
    lead = [F.col(newest).alias("_at")] if newest else []
    rows = items.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    once = rows.groupBy(F.col(group).alias("_group"), F.col(item).alias("_item")).agg(F.max(F.struct(*lead, *known)).alias("_r"))
    fused, total = once.select("_group", "_item", *[F.col(f"_r.{s}").alias(s) for s in scores]), F.lit(0.0)
    for s in scores:
        fused = competition_ranks(materialize(fused), ["_group"], s, ["_item"], f"rank_{s}")
        total = total + F.lit(1.0) / (F.lit(float(k)) + F.col(f"rank_{s}"))
    return fused.select(F.col("_group").alias(group), F.col("_item").alias(item), *[f"rank_{s}" for s in scores], total.alias("fused"))


def _tie_break(scores: Sequence[str]):
    """Among equal totals the item with the better best rank comes first, then the smaller id."""
    return F.least(*[F.col(f"rank_{s}") for s in scores])


def first_of_group(fused: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """(group, item) with the greatest total; found by a map-side combined maximum, not by sorting groups."""
    best = F.max_by(F.col(item), F.struct("fused", (-_tie_break(scores)).alias("b"), (-F.col(item)).alias("i")))
    return fused.groupBy(group).agg(best.alias(item))


SCORES = ("reranker_score", "rrf_score")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Each query's citations with the rank by either score and their fused score."""
    return fuse_scores(table(spark, d, "citations"), "query_id", "chunk_id", SCORES, "logged_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id): for each query the citation that comes first."""
    return first_of_group(p4_ranking(spark, d), "query_id", "chunk_id", SCORES)


_FUSED = """
WITH r AS (SELECT query_id, chunk_id, CASE WHEN isnan(reranker_score) THEN NULL ELSE reranker_score END AS a, CASE WHEN isnan(rrf_score) THEN NULL ELSE rrf_score END AS b, logged_at FROM citations WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL),
o AS (SELECT query_id, chunk_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY logged_at DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST) AS n FROM r) WHERE n = 1),
m AS (SELECT query_id, chunk_id, coalesce(a, min(a) OVER (PARTITION BY query_id)) AS a, coalesce(b, min(b) OVER (PARTITION BY query_id)) AS b FROM o),
f AS (SELECT query_id, chunk_id, rank() OVER (PARTITION BY query_id ORDER BY a DESC) AS rank_reranker_score, rank() OVER (PARTITION BY query_id ORDER BY b DESC) AS rank_rrf_score FROM m),
g AS (SELECT *, 0.0::DOUBLE + 1.0::DOUBLE / (60.0::DOUBLE + rank_reranker_score) + 1.0::DOUBLE / (60.0::DOUBLE + rank_rrf_score) AS fused FROM f)
"""

QUERIES = {"p4_found": p4_found, "p4_ranking": p4_ranking}

SQL = {
    "p4_found": _FUSED + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, least(rank_reranker_score, rank_rrf_score), chunk_id) AS n FROM g) WHERE n = 1",
    "p4_ranking": _FUSED + "SELECT query_id, chunk_id, rank_reranker_score, rank_rrf_score, fused FROM g",
}
