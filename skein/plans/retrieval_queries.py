"""Queries of access control, text, lexical and dense retrieval, fusion, reranking and context packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.acl import LEVELS, AccessContext, acl_predicate, acl_predicate_lenient
from skein.operators import chunking, context, dense, fusion, lexical, rerank
from skein.plans.common import ACL, allowed_chunks, allowed_documents, bm25, cosine, portable, question_vectors, questions, rrf, tokens
from skein.session import materialize
from skein.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, filename FROM documents WHERE {ACL}")
def acl_visible_documents(spark: SparkSession, d: str) -> DataFrame:
    from skein.plans.common import CALLER

    return table(spark, d, "documents").filter(acl_predicate(CALLER)).select("doc_id", "filename")


_CONTEXTS = [AccessContext(dep, lev, arch) for dep in ("public", "engineering", "finance", "hr") for lev in LEVELS for arch in (False, True)]


def _sql_acl(c: AccessContext) -> str:
    parts = ["true" if c.include_archived else "status = 'active'"]
    if not c.is_admin:
        parts += [f"access_level IN ({', '.join(repr(x) for x in c.allowed_levels)})", f"department IN ('public', '{c.department}')"]
    return " AND ".join(parts)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c.department}' AS department, '{c.access_level}' AS access_level, {str(c.include_archived).lower()} AS include_archived, count(*) FILTER ({_sql_acl(c)}) AS visible FROM documents" for c in _CONTEXTS) + ")")
def acl_matrix_counts(spark, d):
    """All contexts from one scan."""
    docs = table(spark, d, "documents")
    one = docs.agg(*[F.count_if(acl_predicate(c)).alias(str(i)) for i, c in enumerate(_CONTEXTS)])
    rows = F.array(*[F.struct(F.lit(c.department).alias("department"), F.lit(c.access_level).alias("access_level"), F.lit(c.include_archived).alias("include_archived"), F.col(str(i)).alias("visible")) for i, c in enumerate(_CONTEXTS)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("SELECT doc_id FROM documents WHERE coalesce(nullif(lower(trim(status)), ''), 'active') != 'archived' AND coalesce(nullif(lower(trim(access_level)), ''), 'public') NOT IN ('manager', 'admin') AND coalesce(nullif(lower(trim(department)), ''), 'public') IN ('public', 'engineering')")
def acl_lenient_documents(spark, d):
    from skein.plans.common import CALLER

    return table(spark, d, "documents").filter(acl_predicate_lenient(CALLER)).select("doc_id")


@query(f"SELECT doc_id, len({tokens('text')}) AS n_tokens FROM documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens('content')}) AS term FROM chunks) GROUP BY term")
def term_document_frequency(spark, d):
    return lexical.term_stats(lexical.postings(table(spark, d, "chunks"), "id", "content")).select("term", "df")


@query(f"WITH p AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens('content')}) AS term FROM chunks) GROUP BY term), s AS (SELECT count(*) AS n FROM chunks) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM p CROSS JOIN s")
def bm25_idf(spark, d):
    chunks = table(spark, d, "chunks")
    n = float(chunks.count())
    return lexical.term_stats(lexical.postings(chunks, "id", "content")).select("term", F.round(lexical.idf(F.lit(n), F.col("df")), 6).alias("idf"))


def _bm25(spark, d, k=20, acl=True):
    return lexical.bm25(table(spark, d, "chunks"), "id", "content", questions(spark, d), "query_id", "text", k, allowed_chunks(spark, d) if acl else None)


def _vector(spark, d, k=20, acl=True):
    return dense.cosine_topk(table(spark, d, "chunks"), "id", "embedding", question_vectors(spark, d), "query_id", "embedding", k, allowed_documents(spark, d) if acl else None)


@query(f"WITH {bm25(10, False)} SELECT * FROM bm25")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10, False)


@query(f"WITH {bm25(20, True)} SELECT * FROM bm25")
def bm25_topk_acl(spark, d):
    return _bm25(spark, d)


@query(f"WITH {cosine(10, False)} SELECT * FROM vec")
def vector_topk(spark, d):
    return _vector(spark, d, 10, False)


@query(f"WITH {cosine(20, True)} SELECT * FROM vec")
def vector_topk_acl(spark, d):
    return _vector(spark, d)


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    r AS (SELECT query_id, id, 1 - list_cosine_similarity(b.v, q.v) AS d FROM q CROSS JOIN b)
    SELECT query_id, id, round(d, 4) AS distance, round(greatest(0, 1 - d), 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM r) WHERE rank <= 5""")
def vector_knn_join(spark, d):
    """The stated query set, ids divisible by 20, against all vectors of the 64-dimensional table."""
    e = table(spark, d, "embeddings")
    return dense.cosine_topk(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, dim=64)


@query(f"WITH {cosine(1, False)} SELECT query_id, id, similarity FROM vec WHERE similarity >= 0.65")
def semantic_argmax_threshold(spark, d):
    return dense.semantic_argmax(table(spark, d, "chunks"), "id", "embedding", question_vectors(spark, d), "query_id", "embedding")


@query("SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS nulls, count(*) FILTER (len(embedding) != 384) AS other_length, count(*) FILTER (n = 0) AS zeros, count(*) FILTER (abs(n - 1) > 0.001) AS not_unit, count(*) FILTER (len(embedding) != 384) = 0 AS consistent FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunks)")
def vector_consistency(spark, d):
    return dense.vector_consistency(table(spark, d, "chunks"), "embedding")


@query(f"WITH {bm25(20, True)}, {cosine(20, True)}, {rrf([('vector', 'vec'), ('bm25', 'bm25')], 60, 20)} SELECT * FROM rrf")
def hybrid_topk(spark, d):
    """Flagship: lexical and dense candidates that the caller may see, fused by reciprocal ranks."""
    return fusion.rrf([("vector", _vector(spark, d)), ("bm25", _bm25(spark, d))], top_k=20)


_LOGGED = "SELECT DISTINCT query_id, chunk_id AS id, rank FROM (SELECT query_id, chunk_id, rank() OVER (PARTITION BY query_id ORDER BY {0} DESC) AS rank FROM (SELECT query_id, chunk_id, max({0}) AS {0} FROM citations WHERE {0} IS NOT NULL GROUP BY ALL))"


@query(f"WITH a AS ({_LOGGED.format('reranker_score')}), b AS ({_LOGGED.format('rrf_score')}), {rrf([('reranker', 'a'), ('rrf', 'b')], 20, 5)} SELECT * FROM rrf")
def rrf_fusion(spark, d):
    """Logged rankings fused with another constant."""
    from pyspark.sql.window import Window

    c = table(spark, d, "citations")

    def ranked(s):
        once = c.filter(F.col(s).isNotNull()).groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max(s).alias("score"))
        return once.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))

    return fusion.rrf([("reranker", ranked("reranker_score")), ("rrf", ranked("rrf_score"))], k=20, top_k=5)


_GRAPH_BRANCH = "SELECT e.id AS query_id, r.chunk_id AS id, row_number() OVER (PARTITION BY e.id ORDER BY r.chunk_id) AS rank FROM eval_questions e JOIN (SELECT DISTINCT document_id, chunk_id FROM relationships WHERE chunk_id IS NOT NULL) r ON r.document_id = e.expected_pages[1].document_id"


def _graph_branch(spark, d):
    from pyspark.sql.window import Window

    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.get(F.col("expected_pages"), F.lit(0)).getField("document_id").cast("long").alias("document_id"))
    r = table(spark, d, "relationships").filter("chunk_id IS NOT NULL").select("document_id", F.col("chunk_id").alias("id")).distinct()
    return q.join(r, "document_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).select("query_id", "id", "rank")


_FUSED = f"""fused AS (SELECT query_id, id, CASE WHEN v.rank IS NOT NULL AND g.rank IS NOT NULL THEN 'hybrid_graph_vector' WHEN v.rank IS NOT NULL THEN 'vector' ELSE 'graph' END AS source,
    concat_ws(',', CASE WHEN v.rank IS NOT NULL THEN 'vector' END, CASE WHEN g.rank IS NOT NULL THEN 'graph' END) AS retrieved_by, v.rank AS vector_rank, g.rank AS graph_rank
    FROM vec v FULL OUTER JOIN g USING (query_id, id) WHERE id IN (SELECT c.id FROM chunks c JOIN documents d ON d.doc_id = c.document_id WHERE {ACL}))"""


def _fused(spark, d):
    return fusion.fuse_evidence(_vector(spark, d, 20, False), _graph_branch(spark, d), allowed_chunks(spark, d))


@query(f"WITH {cosine(20, False)}, g AS ({_GRAPH_BRANCH}), {_FUSED} SELECT * FROM fused")
def evidence_fusion(spark, d):
    return _fused(spark, d)


@query(f"WITH {cosine(20, False)}, g AS ({_GRAPH_BRANCH}), {_FUSED} SELECT query_id, count(*) FILTER (vector_rank IS NOT NULL) AS vector_count, count(*) FILTER (graph_rank IS NOT NULL) AS graph_count, count(*) FILTER (vector_rank IS NOT NULL AND graph_rank IS NOT NULL) AS overlap_count, count(*) AS fused_count FROM fused GROUP BY query_id")
def fusion_dedup_stats(spark, d):
    return fusion.fusion_stats(_fused(spark, d))


_HEADERS = """lines AS (SELECT r.chunk_id AS id, s.canonical_name || ' --[' || r.relationship_type || ']--> ' || t.canonical_name AS line, min(r.id) AS first FROM relationships r JOIN entities s ON s.id = r.source_entity_id JOIN entities t ON t.id = r.target_entity_id WHERE r.chunk_id IS NOT NULL GROUP BY ALL),
    headers AS (SELECT id, '[GRAPH PATH]' || chr(10) || string_agg(line, chr(10) ORDER BY first, line) AS header FROM lines GROUP BY id)"""


def _headers(spark, d):
    from skein.operators.graph_query import named_edges

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return rerank.graph_context(named_edges(table(spark, d, "relationships"), table(spark, d, "entities"), docs))


@query(f"WITH {_HEADERS} SELECT c.id, CASE WHEN header IS NOT NULL THEN header || chr(10) || chr(10) || '[DOCUMENT CONTENT]' || chr(10) || content ELSE content END AS candidate FROM chunks c LEFT JOIN headers USING (id)")
def candidate_text_graph_aware(spark, d):
    c = table(spark, d, "chunks").select("id", "content").join(_headers(spark, d), "id", "left")
    return c.select("id", rerank.candidate_text(F.col("content"), F.col("header"), True).alias("candidate"))


_RERANKED = f"""cand AS (SELECT b.query_id, b.id, b.rank AS initial_rank, e.question AS q, c.content FROM bm25 b JOIN eval_questions e ON e.id = b.query_id JOIN chunks c ON c.id = b.id),
    sc AS (SELECT query_id, id, initial_rank, round(CASE WHEN len(list_distinct({tokens('q')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({tokens('q')}), {tokens('content')})) / len(list_distinct({tokens('q')}))::DOUBLE END, 6) AS reranker_score FROM cand),
    rr AS (SELECT query_id, id, reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, initial_rank, id) AS rank, initial_rank FROM sc QUALIFY rank <= 8)"""


def _reranked(spark, d, found=None):
    found = _bm25(spark, d, 25) if found is None else found
    c = found.join(questions(spark, d).withColumnRenamed("text", "query"), "query_id").join(table(spark, d, "chunks").select("id", F.col("content").alias("text")), "id")
    return rerank.rerank(c)


@query(f"WITH {bm25(25, True)}, {_RERANKED} SELECT * FROM rr")
def rerank_lexical(spark, d):
    return _reranked(spark, d)


@query(f"WITH {bm25(25, True)}, {_RERANKED} SELECT query_id, id, initial_rank, rank AS final_rank, initial_rank - rank AS migration FROM rr")
def rank_migration(spark, d):
    r = _reranked(spark, d)
    return r.select("query_id", "id", "initial_rank", F.col("rank").alias("final_rank"), (F.col("initial_rank") - F.col("rank")).alias("migration"))


@query("SELECT DISTINCT query_id, source_id, chunk_id, concat_ws(' | ', '[' || source_id || '] ' || filename, 'Page ' || page_number, CASE WHEN section != 'General' AND section != '' THEN 'Section: ' || section END) AS formatted FROM citations")
def citations_formatted(spark, d):
    c = table(spark, d, "citations")
    return c.select("query_id", "source_id", "chunk_id", context.citation(F.col("source_id"), F.col("filename"), F.col("page_number"), F.col("section")).alias("formatted")).distinct()


_BLOCKS = """once AS (SELECT DISTINCT c.query_id, c.chunk_id, c.filename, c.page_number, c.section FROM citations c),
    heads AS (SELECT o.query_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.chunk_id, o.filename, o.page_number, o.section) AS rank, o.chunk_id, o.filename, o.page_number, o.section, regexp_replace(k.content, '^[\\t\\n\\x0b\\f\\r ]+|[\\t\\n\\x0b\\f\\r ]+$', '', 'g') AS content FROM once o JOIN chunks k ON k.id = o.chunk_id),
    b AS (SELECT query_id, rank, chunk_id, content, concat_ws(chr(10), '[SOURCE ' || rank || ']', 'Document: ' || filename, 'Page: ' || page_number, CASE WHEN section != 'General' THEN 'Section: ' || section END, 'Chunk ID: ' || chunk_id, '', 'Content:') || chr(10) AS head FROM heads),
    f AS (SELECT *, CASE WHEN rank = 1 AND length(head || content) + 1 > 3000 THEN head || substr(content, 1, greatest(50, 2999 - length(head))) || '...' || chr(10) ELSE head || content || chr(10) END AS block FROM b),
    packed AS (SELECT query_id, rank, chunk_id, block, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT - 2 AS used_chars FROM f QUALIFY rank = 1 OR used_chars <= 3000)"""


def _packed(spark, d):
    from pyspark.sql.window import Window

    c = table(spark, d, "citations").select("query_id", "chunk_id", "filename", "page_number", "section").distinct()
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id", "filename", "page_number", "section")))
    k = c.join(table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    head = context.block(F.col("rank"), F.col("filename"), F.col("page_number"), F.col("section"), F.col("chunk_id"), F.lit(None).cast("array<string>"), F.lit(""))
    return context.pack(k.select("query_id", "rank", "chunk_id", head.alias("head"), "content"), 3000)


@query(f"WITH {_BLOCKS} SELECT query_id, rank, chunk_id, block, used_chars FROM packed")
def context_pack(spark, d):
    return _packed(spark, d)


@query("SELECT DISTINCT query_id, chunk_id, CASE WHEN list_contains(retrieved_by, 'vector') AND list_contains(retrieved_by, 'graph') THEN 'hybrid' WHEN list_contains(retrieved_by, 'graph') THEN 'graph' WHEN list_contains(retrieved_by, 'vector') THEN 'vector' ELSE 'other' END AS badge FROM citations")
def provenance_badges(spark, d):
    return table(spark, d, "citations").select("query_id", "chunk_id", context.provenance_badge(F.col("retrieved_by")).alias("badge")).distinct()


_STRIPS = "regexp_replace({}, '^[\\t\\n\\x0b\\f\\r ]+|[\\t\\n\\x0b\\f\\r ]+$', '', 'g')"


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 12) AS document_key, substr(sha256(text), 1, 12) IS NOT DISTINCT FROM lower(content_hash) AS hash_holds FROM documents")
def content_hashes(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.document_key(c).alias("document_key"), T.content_hash(c).eqNullSafe(F.lower("content_hash")).alias("hash_holds"))


@query(f"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\\t\\n\\x0b\\f\\r ]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIPS.format('x')}), lambda x: length(x) > 0)) AS n_sentences, len(list_filter(list_transform(string_split(regexp_replace(text, '\\n[\\t\\n\\x0b\\f\\r ]*\\n', chr(1), 'g'), chr(1)), lambda x: {_STRIPS.format('x')}), lambda x: length(x) > 0)) AS n_paragraphs FROM documents WHERE text IS NOT NULL")
def sentence_units(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.isNotNull()).select("doc_id", F.size(T.sentences(t)).alias("n_sentences"), F.size(T.paragraphs(t)).alias("n_paragraphs"))


# RE2's word boundary knows ASCII letters only, so the letters around a hyphen are spelled out; twice, as neighbouring matches share one.
_MONTH_SQL = reduce(lambda s, m: f"regexp_replace({s}, '\\b({'Sept|Sep' if m == 'September' else m[:3]})\\b\\.?[\\t\\n\\x0b\\f\\r ]*(\\d{{1,2}}),?[\\t\\n\\x0b\\f\\r ]*((?:19|20)\\d\\d)\\b', '{m} \\2, \\3 (\\1. \\2, \\3)', 'gi')", [m for m in T.MONTHS if m != "May"],
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '(^|[^\\p{L}\\p{N}_])([A-Za-z]{2,})-[\\t\\n\\x0b\\f\\r ]*\\n[\\t\\n\\x0b\\f\\r ]*([a-z]{2,})([^\\p{L}\\p{N}_]|$)', '\\1\\2\\3\\4', 'g'), '(^|[^\\p{L}\\p{N}_])([A-Za-z]{2,})-[\\t\\n\\x0b\\f\\r ]*\\n[\\t\\n\\x0b\\f\\r ]*([a-z]{2,})([^\\p{L}\\p{N}_]|$)', '\\1\\2\\3\\4', 'g'), '(\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?[\\t\\n\\x0b\\f\\r ]*\\d{1,2}),?[\\t\\n\\x0b\\f\\r ]*\\n\\n([^\\n]+(?:\\n[^\\n]+)?)\\n\\n(20\\d\\d)\\b', '\\1, \\3\n\n\\2', 'g')")


@query(f"SELECT doc_id, sha256({_STRIPS.format(f'''regexp_replace({_MONTH_SQL}, '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')''')}) AS normalized_sha FROM documents WHERE text IS NOT NULL")
def normalize_text(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("normalized_sha"))


@query("SELECT doc_id, count(*) AS n_slices FROM (SELECT doc_id, trim(substr(text, i * 650 + 1, 800), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 650.0))::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL)) WHERE length(s) > 0 GROUP BY doc_id")
def hard_slice_counts(spark, d):
    s = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.hard_slices(F.col("text"), 800, 150)).cast("long").alias("n_slices"))
    return s.filter("n_slices > 0")


@query()
def chunk_documents(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query()
def ingestion_summary(spark, d):
    return chunking.ingestion_summary(materialize(chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text")))
