"""Retrieval of evidence by text, vectors and graph, its fusion, reranking and what is reported of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import context, fusion, graph_query, rerank
from skein.session import materialize

SEEDS, RELATIONSHIPS = 10, 50


def graph_candidates(found: DataFrame) -> DataFrame:
    """(query_id, id, rank, facts): the chunks that traversed edges come from, ranked by id.

    facts has the edges of each chunk, first hops first, then by id; an edge
    of the second hop is led by the edge before it.  Edges without a chunk
    give no candidate.
    """
    lines = F.array_compact(F.array("lead", "fact"))
    per = found.filter(F.col("chunk_id").isNotNull()).groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hop", F.col("id").alias("edge"), lines.alias("lines")))), lambda x: x["lines"])).alias("facts"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).select("query_id", "id", "rank", "facts")


@dataclass
class Retrieved:
    """What one call has found: fused (query_id, id, source, retrieved_by, vector_rank, graph_rank, facts), reranked (with telemetry), and diagnostics, one row per query."""

    fused: DataFrame
    reranked: DataFrame
    diagnostics: DataFrame


def retrieve_fused(queries: DataFrame, ranked: DataFrame, seeds: DataFrame, found: DataFrame, texts: DataFrame, allowed: DataFrame, mode: str = "baseline", top_k: int = rerank.TOP, scorer=rerank.lexical_score, candidate_k: int = rerank.CANDIDATES) -> Retrieved:
    """Fuse the ranked candidates (query_id, id, rank) with those of traversed edges, and rerank them for the queries (query_id, text).

    texts has (id, text) of every chunk, allowed the ids that the caller may
    see.  Candidates of the ranking stand before those that only the graph
    has.  A blank query finds nothing (empty_query); one without reranked
    candidates has no_evidence.  An error of a branch is raised, not hidden.
    """
    asked = queries.filter(F.length(F.trim("text")) > 0).select("query_id", F.col("text").alias("query"))
    graph = graph_candidates(found)
    fused = materialize(fusion.fuse_evidence(ranked, graph, allowed).join(asked.select("query_id"), "query_id", "left_semi"))
    c = fused.join(asked, "query_id").join(texts.select("id", "text"), "id")
    c = c.select("query_id", "query", "id", "text", rerank.header("facts").alias("header"), F.coalesce("vector_rank", F.lit(candidate_k) + F.col("graph_rank")).alias("rank"))
    best = materialize(rerank.rerank(c, scorer, top_k, mode, telemetry=True))
    n = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked_count"))
    vectors = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("vector_candidates"))
    chunks = graph.groupBy("query_id").agg(F.count(F.lit(1)).alias("graph_candidates"))
    both = fusion.fusion_stats(fused).select("query_id", "overlap_count", "fused_count")
    j = graph_query.retrieval_status(queries, seeds, found).withColumnRenamed("status", "graph_status")
    for part in (n, vectors, chunks, both):
        j = j.join(part, "query_id", "left")
    counts = ("vector_candidates", "graph_candidates", "overlap_count", "fused_count", "reranked_count")
    status = F.when(F.col("graph_status") == "empty_query", "empty_query").when(F.col("reranked_count").isNull(), "no_evidence").otherwise("success")
    keep = F.when(F.col("graph_status") == "empty_query", F.lit(0))
    diagnostics = j.select("query_id", status.alias("status"), "graph_status", F.col("seed_count").alias("graph_seed_count"), F.col("relationship_count").alias("graph_relationship_count"), F.col("connected_entity_count").alias("graph_connected_count"), *[keep.otherwise(F.coalesce(x, F.lit(0))).cast("long").alias(x) for x in counts])
    return Retrieved(fused, best, diagnostics)


def context_of(got: Retrieved, chunks: DataFrame, documents: DataFrame, max_chars: int = context.MAX_CHARS) -> DataFrame:
    """`context.pack` of the reranked chunks, with at most three of their facts in each block's head."""
    facts = got.fused.select("query_id", "id", "facts")
    c = chunks.select("id", "document_id", "page_number", "section", "content")
    k = got.reranked.select("query_id", "id", "rank").join(facts, ["query_id", "id"]).join(c, "id").join(documents.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    head = context.block(F.col("rank"), F.coalesce("filename", F.col("document_id").cast("string")), F.col("page_number"), F.col("section"), F.col("id"), F.col("facts"), F.lit(""))
    return context.pack(k.select("query_id", "rank", F.col("id").alias("chunk_id"), head.alias("head"), "content"), max_chars)


def citations(packed: DataFrame, got: Retrieved, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, source_id, chunk_id, document_id, filename, page_number, section, reranker_score, retrieved_by, formatted) of the sources that a context holds."""
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number", "section")
    d = documents.select(F.col("doc_id").alias("document_id"), "filename")
    by = got.fused.select("query_id", F.col("id").alias("chunk_id"), "retrieved_by")
    score = got.reranked.select("query_id", F.col("id").alias("chunk_id"), "reranker_score")
    j = packed.select("query_id", F.col("rank").alias("source_id"), "chunk_id").join(c, "chunk_id").join(d, "document_id").join(by, ["query_id", "chunk_id"]).join(score, ["query_id", "chunk_id"])
    name = F.coalesce("filename", F.col("document_id").cast("string"))
    return j.select("query_id", "source_id", "chunk_id", "document_id", name.alias("filename"), "page_number", "section", "reranker_score", "retrieved_by", context.citation(F.col("source_id"), name, F.col("page_number"), F.col("section")).alias("formatted"))
