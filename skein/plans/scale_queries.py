"""Queries of the general scale problems: changed records and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import incremental, skew
from skein.session import materialize
from skein.sources.tables import table

PROGRESS_FIELDS = ("status", "attempts")


def p2_states(spark: SparkSession, d: str) -> DataFrame:
    upto = incremental.read_up_to(table(spark, d, "extraction_runs"))
    return incremental.latest_state(table(spark, d, "chunk_progress"), "chunk_id", PROGRESS_FIELDS, "updated_at", "loaded_at", F.col("loaded_at") <= F.lit(upto).cast("timestamp"))


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, status, attempts, is_new): what the next run has to take, with its state.

    The tables say what the succeeded runs have read, not what they saved, so
    their version is published first; the next run descends from its tree.
    """
    states = materialize(p2_states(spark, d))
    side = lambda s: states.filter(f"has_{s}").select(F.col("key").alias("chunk_id"), *[F.col(f"{s}_fields.{f}").alias(f) for f in PROGRESS_FIELDS])
    store = incremental.MerkleStore(spark)
    store.run(side("then"), "chunk_id", PROGRESS_FIELDS, lambda rows: rows.limit(0))
    seen = store.state().select("chunk_id", F.lit(False).alias("is_new"))
    take = lambda rows: rows.join(seen, "chunk_id", "left").select("chunk_id", *PROGRESS_FIELDS, F.coalesce("is_new", F.lit(True)).alias("is_new"))
    return store.run(side("now"), "chunk_id", PROGRESS_FIELDS, take)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id): chunks that were added or changed since the last successful run."""
    return p2_changes(spark, d).select("chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(side, entity_id): entities that hold at least 2 percent of all rows on that side."""
    return skew.heavy_ends(table(spark, d, "relationships"))


def p3_edges_per_side(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, side, n_edges): for every entity, also those without an edge."""
    per = skew.edges_per_side(table(spark, d, "relationships"))
    sides = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side"))
    return sides.join(per, ["side", "entity_id"], "left").select("entity_id", "side", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


_RUNS = """
runs AS (SELECT run_id, arg_max(outcome, logged_at) AS outcome, arg_max(read_upto, logged_at) AS read_upto FROM extraction_runs GROUP BY run_id),
w AS (SELECT max(read_upto) AS upto FROM runs WHERE outcome = 'succeeded'),
cur AS (SELECT chunk_id, status, attempts FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC, attempts DESC) AS rn FROM chunk_progress WHERE chunk_id IS NOT NULL) WHERE rn = 1),
old AS (SELECT chunk_id, status, attempts FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC, attempts DESC) AS rn FROM chunk_progress, w WHERE chunk_id IS NOT NULL AND loaded_at <= w.upto) WHERE rn = 1)
"""

QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p3_found": p3_found, "p3_edges_per_side": p3_edges_per_side}

SQL = {
    "p2_found": f"WITH {_RUNS} SELECT cur.chunk_id FROM cur LEFT JOIN old USING (chunk_id) WHERE old.chunk_id IS NULL OR cur.status IS DISTINCT FROM old.status OR cur.attempts IS DISTINCT FROM old.attempts",
    "p2_changes": f"WITH {_RUNS} SELECT cur.chunk_id, cur.status, cur.attempts, old.chunk_id IS NULL AS is_new FROM cur LEFT JOIN old USING (chunk_id) WHERE old.chunk_id IS NULL OR cur.status IS DISTINCT FROM old.status OR cur.attempts IS DISTINCT FROM old.attempts",
    "p3_found": """
        WITH ends AS (SELECT 'source' AS side, source_entity_id AS entity_id FROM relationships UNION ALL SELECT 'target', target_entity_id FROM relationships),
        per AS (SELECT side, entity_id, count(*) AS n FROM ends GROUP BY side, entity_id)
        SELECT side, entity_id FROM per WHERE entity_id IS NOT NULL AND n >= 0.02 * (SELECT count(*) FROM relationships)""",
    "p3_edges_per_side": """
        WITH ends AS (SELECT 'source' AS side, source_entity_id AS entity_id FROM relationships UNION ALL SELECT 'target', target_entity_id FROM relationships),
        per AS (SELECT side, entity_id, count(*) AS n FROM ends GROUP BY side, entity_id)
        SELECT e.id AS entity_id, s.side, coalesce(per.n, 0) AS n_edges FROM entities e CROSS JOIN (VALUES ('source'), ('target')) s(side) LEFT JOIN per ON per.side = s.side AND per.entity_id = e.id""",
}
