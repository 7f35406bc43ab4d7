"""The service's entry points over tables: validated requests in, one row per question out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.acl import AccessContext, acl_predicate
from skein.operators import context, dense, fusion, graph_query, hybrid, lexical, rerank
from skein.session import materialize


@dataclass(frozen=True)
class Request:
    """Bounds of a request; anything outside raises."""

    query: str
    top_k: int = 5
    candidate_k: int = 25

    def __post_init__(self):
        if not 1 <= len(self.query.strip()) <= 2000:
            raise ValueError("query must have 1 to 2000 characters")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be 1 to 50")
        if not 1 <= self.candidate_k <= 100:
            raise ValueError("candidate_k must be 1 to 100")


@dataclass
class Corpus:
    """Tables that are asked: documents (doc_id, filename, access columns), chunks (id, document_id, content, page_number, section, embedding), and, for the graph branch, relationships and entities."""

    documents: DataFrame
    chunks: DataFrame
    relationships: DataFrame | None = None
    entities: DataFrame | None = None

    def allowed(self, ctx: AccessContext) -> DataFrame:
        return self.documents.filter(acl_predicate(ctx)).select(F.col("doc_id").alias("document_id"))

    def allowed_chunks(self, ctx: AccessContext) -> DataFrame:
        return self.chunks.select("id", "document_id").join(self.allowed(ctx), "document_id", "left_semi").select("id")

    def candidates(self, queries: DataFrame, vectors: DataFrame | None, ctx: AccessContext, k: int = 25) -> DataFrame:
        """Fused lexical and, where query vectors are given, dense candidates; each retriever leaves 20."""
        lists = [("bm25", lexical.bm25(self.chunks, "id", "content", queries, "query_id", "text", 20, self.allowed_chunks(ctx)))]
        if vectors is not None:
            lists.insert(0, ("vector", dense.cosine_topk(self.chunks, "id", "embedding", vectors, "query_id", "embedding", 20, self.allowed(ctx))))
        return fusion.rrf(lists, top_k=k)

    def traverse(self, queries: DataFrame, ctx: AccessContext, depth: int = 2, max_results: int = hybrid.RELATIONSHIPS, max_seeds: int = hybrid.SEEDS) -> tuple[DataFrame, DataFrame]:
        """(seeds, found): entities that the queries' phrases name, and the edges around them that the caller may see; both empty without a graph."""
        spark = queries.sparkSession
        if self.relationships is None or self.entities is None:
            kind = queries.schema["query_id"].dataType.simpleString()
            none = f"query_id {kind}, id long, source_entity_id long, source_name string, relationship_type string, target_entity_id long, target_name string, document_id long, chunk_id long, page_number int, path string, fact string, lead string, hop int"
            return spark.createDataFrame([], f"query_id {kind}, entity_id long"), spark.createDataFrame([], none)
        phrases = queries.select("query_id", F.posexplode(graph_query.keywords(F.col("text"))).alias("pos", "candidate"))
        seeds = materialize(graph_query.find_seeds(materialize(phrases), self.entities, max_seeds))
        edges = self.relationships.join(self.allowed(ctx), "document_id", "left_semi").select("id", "source_entity_id", "relationship_type", "target_entity_id", "document_id", "chunk_id", "page_number")
        return seeds, materialize(graph_query.traverse(edges, seeds, depth, max_results, self.entities))

    def retrieve(self, queries: DataFrame, vectors: DataFrame | None, ctx: AccessContext, top_k: int = 8, candidate_k: int = 25, mode: str = "baseline", scorer=rerank.lexical_score, depth: int = 2) -> hybrid.Retrieved:
        """Evidence of all branches for queries (query_id, text), fused and reranked, with diagnostics."""
        seeds, found = self.traverse(queries, ctx, depth)
        ranked = materialize(self.candidates(queries, vectors, ctx, candidate_k))
        texts = self.chunks.select("id", F.col("content").alias("text"))
        return hybrid.retrieve_fused(queries, ranked, seeds, found, texts, self.allowed_chunks(ctx), mode, top_k, scorer, candidate_k)

    def ask(self, queries: DataFrame, vectors: DataFrame | None, ctx: AccessContext, top_k: int = 8, candidate_k: int = 25, max_chars: int = context.MAX_CHARS, generate=None, mode: str = "baseline") -> Answered:
        """Answers with their citations and diagnostics; a query without evidence gets the fixed refusal, and no call to the model."""
        got = self.retrieve(queries, vectors, ctx, top_k, candidate_k, mode)
        packed = materialize(hybrid.context_of(got, self.chunks, self.documents, max_chars))
        answers = context.answer(queries.withColumnRenamed("text", "query"), context.contexts(packed), generate)
        size = packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.max("used_chars").alias("context_chars"))
        zero = F.lit(0).cast("long")
        diagnostics = got.diagnostics.join(size, "query_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("evidence_count", "context_chars")})
        return Answered(answers, hybrid.citations(packed, got, self.chunks, self.documents), diagnostics)

    def answer(self, queries: DataFrame, vectors: DataFrame | None, ctx: AccessContext, **options) -> DataFrame:
        """(query_id, query, answer, grounded) of `ask`."""
        return self.ask(queries, vectors, ctx, **options).answers


@dataclass
class Answered:
    """answers (query_id, query, answer, grounded), citations (one row per source of a context), diagnostics (one row per query)."""

    answers: DataFrame
    citations: DataFrame
    diagnostics: DataFrame
