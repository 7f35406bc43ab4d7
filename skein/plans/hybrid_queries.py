"""Queries of the whole path: graph seeds and candidates, fusion, reranking, context, citations, answers, diagnostics, and two systems side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import STOP_WORDS
from skein.operators import context, evaluation, fusion, graph_query, hybrid, rerank
from skein.plans.common import ACL, allowed_chunks, bm25, cosine, questions, rrf, tokens
from skein.plans.eval_queries import _GOLD, _METRICS, _sql_found, _with_found
from skein.plans.graph_queries import _CAND, _HOP2, _SEED, _edges, _entity_candidates
from skein.plans.retrieval_queries import _bm25, _vector
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


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS)) + "]"
_TRIM = "regexp_replace({}, '^[ .\\-,]+|[ .\\-,]+$', '', 'g')"
_RUN = _TRIM.format("array_to_string(g, ' ')")
_RUNS = " || ".join(f"list_transform(list_filter(list_transform(range(1, len(ws) - {n} + 2), lambda i: ws[i:i + {n} - 1]), lambda g: len(list_filter(g, lambda w: NOT list_contains(stop, lower(w)))) > 0), lambda g: {_RUN})" for n in range(1, 5))
_KW = f"""kw AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY length(k) DESC, len(string_split(k, ' ')) DESC, k) - 1 AS pos, k AS keyword FROM (
    SELECT query_id, stop, unnest(list_distinct(list_transform(regexp_extract_all(c, '["'']([^"'']+)["'']', 1), lambda x: trim(x, ' ')) || list_transform(regexp_extract_all(c, '([A-Z0-9][a-zA-Z0-9_\\-./]*(?:\\s+[A-Z0-9][a-zA-Z0-9_\\-./]*)*)', 1), lambda x: {_TRIM.format('x')}) || {_RUNS})) AS k
    FROM (SELECT id AS query_id, question AS c, {_STOP} AS stop, list_filter(string_split_regex(regexp_replace(question, '[^\\p{{L}}\\p{{N}}_\\s\\-./]', ' ', 'g'), '\\s+'), lambda w: w != '') AS ws FROM eval_questions WHERE question IS NOT NULL))
    WHERE length(k) >= 2 AND NOT list_contains(stop, lower(k)))"""


@query(f"WITH {_KW} SELECT query_id, pos, keyword FROM kw")
def query_keywords(spark, d):
    """(query_id, pos, keyword) of every question."""
    return questions(spark, d).select("query_id", F.posexplode(graph_query.keywords(F.col("text"))).alias("pos", "keyword"))


# Candidates of the seeds: the name of an entity of each question's document, as a stand-in for an extractor, then the question's own phrases.
_SEEDS = f"""{_CAND.replace('seeds', 'stand_in')}, {_KW}, cands AS (SELECT query_id, -1 AS pos, candidate FROM cand UNION ALL SELECT query_id, pos, keyword FROM kw),
    lead AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, candidate) <= {graph_query.MAX_CANDIDATES}),
    short AS (SELECT query_id, candidate FROM cands WHERE length(candidate) BETWEEN 3 AND 35 AND len(list_filter(string_split_regex(candidate, '\\s+'), lambda w: w != '')) <= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, candidate) <= {graph_query.MAX_LIKE}),
    en AS (SELECT id AS entity_id, length(canonical_name) AS len, unnest([lower(canonical_name), lower(display_name)]) AS name FROM entities),
    ex AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, entity_id) AS rank FROM (SELECT DISTINCT query_id, entity_id, len FROM lead JOIN en ON en.name = lower(lead.candidate)) QUALIFY rank <= {hybrid.SEEDS}),
    have AS (SELECT query_id, count(*) AS have FROM ex GROUP BY query_id),
    lk AS (SELECT query_id, entity_id FROM (SELECT query_id, entity_id, room, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, entity_id) AS n FROM (
        SELECT DISTINCT s.query_id, e.id AS entity_id, length(e.canonical_name) AS len, {hybrid.SEEDS} - coalesce(h.have, 0) AS room FROM short s LEFT JOIN have h USING (query_id) JOIN entities e ON e.canonical_name ILIKE '%' || s.candidate || '%' OR e.display_name ILIKE '%' || s.candidate || '%'
        WHERE coalesce(h.have, 0) < {hybrid.SEEDS} AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = s.query_id AND ex.entity_id = e.id))) WHERE n <= room),
    seeds AS (SELECT query_id, entity_id FROM ex UNION ALL SELECT query_id, entity_id FROM lk)"""


def _find_seeds(spark, d):
    q = questions(spark, d).select("query_id", F.posexplode(graph_query.keywords(F.col("text"))).alias("pos", "candidate"))
    stand_in = _entity_candidates(spark, d).select("query_id", F.lit(-1).alias("pos"), "candidate")
    return materialize(graph_query.find_seeds(materialize(stand_in.unionByName(q)), table(spark, d, "entities"), hybrid.SEEDS))


@query(f"WITH {_SEEDS} SELECT query_id, entity_id FROM seeds")
def graph_seeds(spark, d):
    """Entities that a question starts from."""
    return _find_seeds(spark, d)


_TRAVERSED = _HOP2.replace(_SEED, _SEEDS).replace("WHERE n <= 20)", f"WHERE n <= {hybrid.RELATIONSHIPS})")
_FACTS = f"""{_TRAVERSED}, found AS (SELECT query_id, 1 AS hop, id, source_entity_id, target_entity_id, source_name, relationship_type, target_name, document_id, chunk_id, path AS fact, NULL AS lead FROM hop1
        UNION ALL SELECT query_id, 2, id, source_entity_id, target_entity_id, source_name, relationship_type, target_name, document_id, chunk_id, source_name || ' --[' || relationship_type || ']--> ' || target_name, parent_path FROM e2 WHERE k <= budget),
    gc AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank, facts FROM (SELECT query_id, chunk_id, flatten(list(CASE WHEN lead IS NULL THEN [fact] ELSE [lead, fact] END ORDER BY hop, id)) AS facts FROM found WHERE chunk_id IS NOT NULL GROUP BY ALL))"""
_ALLOWED = f"(SELECT c.id FROM chunks c JOIN documents d ON d.doc_id = c.document_id WHERE {ACL})"
_ASKED = "(SELECT id FROM eval_questions WHERE length(trim(question, ' ')) > 0)"
_FUSED = f"""{cosine(20, True)}, {bm25(20, True)}, {rrf([('vector', 'vec'), ('bm25', 'bm25')], 60, 25)}, {_FACTS},
    fu AS (SELECT query_id, id, CASE WHEN v.rank IS NOT NULL AND g.rank IS NOT NULL THEN 'hybrid_graph_vector' WHEN v.rank IS NOT NULL THEN 'vector' ELSE 'graph' END AS source, concat_ws(',', CASE WHEN v.rank IS NOT NULL THEN 'vector' END, CASE WHEN g.rank IS NOT NULL THEN 'graph' END) AS retrieved_by, v.rank AS vector_rank, g.rank AS graph_rank, g.facts
        FROM rrf v FULL OUTER JOIN gc g USING (query_id, id) WHERE id IN {_ALLOWED} AND query_id IN {_ASKED})"""
_BEST = f"""{_FUSED}, ct AS (SELECT fu.query_id, fu.id, e.question AS q, coalesce(vector_rank, 25 + graph_rank) AS initial_rank, coalesce(c.content, '') AS content, CASE WHEN len(facts) > 0 THEN '[GRAPH PATH]' || chr(10) || array_to_string(list_filter(facts, lambda x, i: list_position(facts, x) = i), chr(10)) || chr(10) || chr(10) || '[DOCUMENT CONTENT]' || chr(10) || coalesce(c.content, '') ELSE coalesce(c.content, '') END AS text FROM fu JOIN chunks c USING (id) JOIN eval_questions e ON e.id = fu.query_id),
    sc AS (SELECT query_id, id, initial_rank, length(text) AS input_char_length, length(content) AS base_char_length, text != content AS graph_augmented, round(CASE WHEN len(list_distinct({tokens('q')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({tokens('q')}), {tokens('text')})) / len(list_distinct({tokens('q')}))::DOUBLE END, 6) AS reranker_score FROM ct),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, initial_rank, id) AS rank FROM sc QUALIFY rank <= 8)"""
_STRIP = "regexp_replace({}, '^[\\t\\n\\x0b\\f\\r ]+|[\\t\\n\\x0b\\f\\r ]+$', '', 'g')"
_PACKED = f"""{_BEST}, hb AS (SELECT b.query_id, b.rank, b.id AS chunk_id, c.document_id, coalesce(d.filename, c.document_id::VARCHAR) AS filename, c.page_number, c.section, b.reranker_score, fu.retrieved_by, {_STRIP.format('c.content')} AS content,
        concat_ws(chr(10), '[SOURCE ' || b.rank || ']', 'Document: ' || coalesce(d.filename, c.document_id::VARCHAR), 'Page: ' || c.page_number, CASE WHEN c.section != 'General' THEN 'Section: ' || c.section END, 'Chunk ID: ' || c.id, CASE WHEN len(fu.facts) > 0 THEN array_to_string(list_transform(fu.facts[1:3], lambda x: '[GRAPH RELATIONSHIP] ' || x), chr(10)) END, '', 'Content:') || chr(10) AS head
        FROM best b JOIN fu USING (query_id, id) JOIN chunks c ON c.id = b.id JOIN documents d ON d.doc_id = c.document_id),
    bl AS (SELECT *, CASE WHEN rank = 1 AND length(head || content) + 1 > 12000 THEN head || substr(content, 1, greatest(50, 11999 - length(head))) || '...' || chr(10) ELSE head || content || chr(10) END AS block FROM hb),
    packed AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT - 2 AS used_chars FROM bl QUALIFY rank = 1 OR used_chars <= 12000)"""


def _found(spark, d):
    seeds = _find_seeds(spark, d)
    return seeds, materialize(graph_query.traverse(_edges(spark, d), seeds, 2, hybrid.RELATIONSHIPS, table(spark, d, "entities")))


def _ranked(spark, d):
    return materialize(fusion.rrf([("vector", _vector(spark, d)), ("bm25", _bm25(spark, d))], top_k=rerank.CANDIDATES))


def _texts(spark, d):
    return table(spark, d, "chunks").select("id", F.col("content").alias("text"))


def _retrieved(spark, d):
    seeds, found = _found(spark, d)
    return hybrid.retrieve_fused(questions(spark, d), _ranked(spark, d), seeds, found, _texts(spark, d), allowed_chunks(spark, d), "graph_aware")


@query(f"WITH {_FACTS} SELECT query_id, id, rank, array_to_string(facts, chr(10)) AS facts FROM gc")
def graph_candidates(spark, d):
    """Chunks of the edges that two hops from the seeds meet, with those edges."""
    return hybrid.graph_candidates(_found(spark, d)[1]).withColumn("facts", F.array_join("facts", "\n"))


@query(f"WITH {_FUSED} SELECT query_id, id, source, retrieved_by, vector_rank, graph_rank, len(facts) AS n_facts FROM fu")
def hybrid_fused(spark, d):
    return _retrieved(spark, d).fused.withColumn("n_facts", F.when(F.col("facts").isNotNull(), F.size("facts"))).drop("facts")


@query(f"WITH {_BEST} SELECT query_id, id, reranker_score, rank, initial_rank, 'graph_aware' AS reranking_mode, input_char_length, base_char_length, graph_augmented FROM best")
def hybrid_reranked(spark, d):
    return _retrieved(spark, d).reranked


def _context(spark, d):
    got = _retrieved(spark, d)
    return got, materialize(hybrid.context_of(got, table(spark, d, "chunks"), table(spark, d, "documents")))


@query(f"WITH {_PACKED} SELECT query_id, rank, chunk_id, block, used_chars FROM packed")
def hybrid_context(spark, d):
    return _context(spark, d)[1]


@query(f"WITH {_PACKED} SELECT query_id, rank AS source_id, chunk_id, document_id, filename, page_number, section, reranker_score, retrieved_by, concat_ws(' | ', '[' || rank || '] ' || filename, 'Page ' || page_number, CASE WHEN section != 'General' AND section != '' THEN 'Section: ' || section END) AS formatted FROM packed")
def hybrid_citations(spark, d):
    got, packed = _context(spark, d)
    return hybrid.citations(packed, got, table(spark, d, "chunks"), table(spark, d, "documents"))


@query(f"WITH {_PACKED}, cx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM packed GROUP BY query_id) SELECT e.id AS query_id, e.question AS query, CASE WHEN length(trim(coalesce(context, ''), ' ')) > 0 THEN regexp_extract(context, '(?s)Content:\\n(.*?[.!?])(?:\\s|$)', 1) || ' [SOURCE 1]' ELSE '{context.NO_EVIDENCE}' END AS answer, length(trim(coalesce(context, ''), ' ')) > 0 AS grounded FROM eval_questions e LEFT JOIN cx ON cx.query_id = e.id")
def rag_answer(spark, d):
    """The whole path: lexical, dense and graph candidates, reranking, packing, and the stand-in answer or the refusal, for every question."""
    return context.answer(questions(spark, d).withColumnRenamed("text", "query"), context.contexts(_context(spark, d)[1]))


@query(f"""WITH {_BEST}, ends AS (SELECT DISTINCT query_id, unnest([source_entity_id, target_entity_id]) AS entity_id FROM found),
    n AS (SELECT e.id AS query_id, length(trim(coalesce(e.question, ''), ' ')) = 0 AS blank, (SELECT count(*) FROM seeds x WHERE x.query_id = e.id) AS s, (SELECT count(*) FROM found x WHERE x.query_id = e.id) AS r, (SELECT count(*) FROM ends x WHERE x.query_id = e.id AND NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = e.id AND z.entity_id = x.entity_id)) AS c,
        (SELECT count(*) FROM rrf x WHERE x.query_id = e.id) AS v, (SELECT count(*) FROM gc x WHERE x.query_id = e.id) AS g, (SELECT count(*) FROM fu x WHERE x.query_id = e.id AND vector_rank IS NOT NULL AND graph_rank IS NOT NULL) AS o, (SELECT count(*) FROM fu x WHERE x.query_id = e.id) AS f, (SELECT count(*) FROM best x WHERE x.query_id = e.id) AS b FROM eval_questions e)
    SELECT query_id, CASE WHEN blank THEN 'empty_query' WHEN b = 0 THEN 'no_evidence' ELSE 'success' END AS status, CASE WHEN blank THEN 'empty_query' WHEN s = 0 THEN 'no_seed_entities_found' ELSE 'success' END AS graph_status, s AS graph_seed_count, r AS graph_relationship_count, c AS graph_connected_count, v AS vector_candidates, g AS graph_candidates, o AS overlap_count, f AS fused_count, b AS reranked_count FROM n""")
def hybrid_diagnostics(spark, d):
    """Counts and statuses of every question."""
    return _retrieved(spark, d).diagnostics


# Two systems side by side: what the ranking alone leaves after reranking, and what it leaves with the graph's candidates.
_ALONE = f"""va AS (SELECT b.query_id, b.id, b.rank AS initial_rank, round(CASE WHEN len(list_distinct({tokens('e.question')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({tokens('e.question')}), {tokens('c.content')})) / len(list_distinct({tokens('e.question')}))::DOUBLE END, 6) AS score FROM rrf b JOIN eval_questions e ON e.id = b.query_id JOIN chunks c ON c.id = b.id),
    alone AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, initial_rank, id) AS rank FROM va QUALIFY rank <= 8)"""
_SIDES = f"""{_BEST}, {_ALONE}, {_GOLD}, {_sql_found('alone')}, v AS (SELECT query_id, {_METRICS} FROM f),
    f2 AS (SELECT g.query_id, g.category, g.gold, coalesce(l.found, []) AS found FROM gold g LEFT JOIN (SELECT query_id, list(id ORDER BY rank) AS found FROM best GROUP BY query_id) l USING (query_id)), h AS (SELECT query_id, {_METRICS} FROM f2),
    u AS (SELECT g.query_id, count(x.id) AS n FROM gold g LEFT JOIN (SELECT DISTINCT query_id, id FROM gc WHERE NOT EXISTS (SELECT 1 FROM rrf WHERE rrf.query_id = gc.query_id AND rrf.id = gc.id)) x ON x.query_id = g.query_id AND list_contains(g.gold, x.id) GROUP BY g.query_id),
    judged AS (SELECT query_id, gold.category, CASE WHEN h.recall_at_3 > v.recall_at_3 OR h.recall_at_5 > v.recall_at_5 OR h.mrr > v.mrr OR u.n > 0 THEN 'hybrid_won' WHEN v.recall_at_3 > h.recall_at_3 OR v.recall_at_5 > h.recall_at_5 OR v.mrr > h.mrr THEN 'vector_won' ELSE 'tie' END AS verdict,
        v.recall_at_3 AS vector_recall_at_3, h.recall_at_3 AS hybrid_recall_at_3, v.recall_at_5 AS vector_recall_at_5, h.recall_at_5 AS hybrid_recall_at_5, v.mrr AS vector_mrr, h.mrr AS hybrid_mrr, u.n AS unique_relevant FROM v JOIN h USING (query_id) JOIN u USING (query_id) JOIN gold USING (query_id))"""
_JUDGED = ("vector_recall_at_3", "hybrid_recall_at_3", "vector_recall_at_5", "hybrid_recall_at_5", "vector_mrr", "hybrid_mrr")


def _judged(spark, d):
    seeds, found = _found(spark, d)
    ranked = _ranked(spark, d)
    got = hybrid.retrieve_fused(questions(spark, d), ranked, seeds, found, _texts(spark, d), allowed_chunks(spark, d), "graph_aware")
    alone = rerank.rerank(ranked.join(questions(spark, d).withColumnRenamed("text", "query"), "query_id").join(_texts(spark, d), "id"))

    def side(best, p):
        f, g = F.col("found"), F.col("gold")
        return _with_found(spark, d, best).select("query_id", *[c.alias(f"{p}_{n}") for c, n in ((evaluation.recall_at(f, g, 3), "recall_at_3"), (evaluation.recall_at(f, g, 5), "recall_at_5"), (evaluation.mrr(f, g), "mrr"))])

    gold = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "category", F.explode_outer(F.array_distinct(F.transform("expected_source_chunks", lambda x: x.cast("long")))).alias("id"))
    only = hybrid.graph_candidates(found).select("query_id", "id").join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hit", F.lit(1))
    unique = gold.join(only, ["query_id", "id"], "left").groupBy("query_id", "category").agg(F.count("hit").alias("unique_relevant"))
    j = side(alone, "vector").join(side(got.reranked, "hybrid"), "query_id").join(unique, "query_id")
    v = evaluation.verdict(F.col("hybrid_recall_at_3"), F.col("vector_recall_at_3"), F.col("hybrid_recall_at_5"), F.col("vector_recall_at_5"), F.col("hybrid_mrr"), F.col("vector_mrr"), F.col("unique_relevant"))
    return j.select("query_id", "category", v.alias("verdict"), *_JUDGED, "unique_relevant")


@query(f"WITH {_SIDES} SELECT query_id, category, verdict, {', '.join(_JUDGED)}, unique_relevant FROM judged")
def verdicts(spark, d):
    """Every question by both systems, and which of them is ahead."""
    return _judged(spark, d)


@query(f"WITH {_SIDES} SELECT category, count(*) AS questions, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _JUDGED)}, count(*) FILTER (verdict = 'hybrid_won') AS hybrid_won, count(*) FILTER (verdict = 'vector_won') AS vector_won, count(*) FILTER (verdict = 'tie') AS tie FROM judged GROUP BY ROLLUP (category)")
def evaluation_summary(spark, d):
    """Means and verdicts per category and over all questions."""
    return evaluation.summary(_judged(spark, d), "category", list(_JUDGED), "verdict", ("hybrid_won", "vector_won", "tie"))
