"""Queries of the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import evaluation, fusion, graph_query
from skein.plans.common import bm25, cosine, questions
from skein.plans.graph_queries import _SEED, _NAMED, _edges, _seeds
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


def _gold(spark, d):
    return table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "category", F.transform("expected_source_chunks", lambda x: x.cast("long")).alias("gold"), "expected_entities", "expected_answer")


def _lists(found):
    """(query_id, found): ids in rank order; at most k of them, as the retrievers leave."""
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))


def _with_found(spark, d, found):
    return _gold(spark, d).join(_lists(found), "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))


_GOLD = "gold AS (SELECT id AS query_id, category, list_transform(expected_source_chunks, lambda x: x::BIGINT) AS gold FROM eval_questions)"
_METRICS = ", ".join(
    [f"CASE WHEN len(gold) = 0 THEN CASE WHEN len(found) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(list_distinct(found[1:{k}]), gold)) / len(list_distinct(gold))::DOUBLE END::DOUBLE AS recall_at_{k}" for k in (1, 3, 5, 10)]
    + [f"CASE WHEN len(gold) = 0 THEN CASE WHEN len(found) = 0 THEN 1.0 ELSE 0.0 END WHEN list_has_any(found[1:{k}], gold) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_{k}" for k in (1, 3, 5, 10)]
    + ["CASE WHEN len(gold) = 0 THEN CASE WHEN len(found) = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(1.0 / list_min(list_filter(list_transform(found, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda i: i IS NOT NULL)), 0.0) END::DOUBLE AS mrr"]
)


def _sql_found(t):
    return f"f AS (SELECT g.query_id, g.category, g.gold, coalesce(l.found, []) AS found FROM gold g LEFT JOIN (SELECT query_id, list(id ORDER BY rank) AS found FROM {t} GROUP BY query_id) l USING (query_id))"


@query(f"WITH {bm25(10, False)}, {_GOLD}, {_sql_found('bm25')} SELECT query_id, {_METRICS} FROM f")
def recall_hit_mrr(spark, d):
    f = _with_found(spark, d, _bm25(spark, d, 10, False))
    return f.select("query_id", *evaluation.retrieval_metrics(F.col("found"), F.col("gold")))


_NAMES = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "hit_at_5", "mrr")


@query(f"WITH {bm25(10, False)}, {_GOLD}, {_sql_found('bm25')}, m AS (SELECT category, {_METRICS} FROM f) SELECT category, count(*) AS questions, {', '.join(f'round(avg({n}), 4) AS {n}' for n in _NAMES)} FROM m GROUP BY ROLLUP (category)")
def category_rollup(spark, d):
    f = _with_found(spark, d, _bm25(spark, d, 10, False))
    return evaluation.summary(f.select("category", *evaluation.retrieval_metrics(F.col("found"), F.col("gold"))), "category", list(_NAMES))


@query(f"WITH {bm25(10, False)}, {_GOLD}, {_sql_found('bm25')}, m AS (SELECT category, {_METRICS} FROM f), s AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in _NAMES)} FROM m GROUP BY category) SELECT {', '.join(f'round(avg({n}), 4) AS {n}' for n in _NAMES)} FROM s")
def macro_average(spark, d):
    f = _with_found(spark, d, _bm25(spark, d, 10, False))
    return evaluation.macro_average(f.select("category", *evaluation.retrieval_metrics(F.col("found"), F.col("gold"))), "category", list(_NAMES))


@query("SELECT category, count(*) AS n FROM eval_questions GROUP BY category")
def category_counts(spark, d):
    return table(spark, d, "eval_questions").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT DISTINCT query_id, chunk_id FROM citations), g AS (SELECT row_number() OVER (ORDER BY id) AS query_id, list_transform(expected_source_chunks, lambda x: x::BIGINT) AS gold FROM eval_questions), j AS (SELECT g.query_id, g.gold, coalesce(list(c.chunk_id) FILTER (c.chunk_id IS NOT NULL), []) AS cited FROM g LEFT JOIN c USING (query_id) GROUP BY ALL) SELECT query_id, CASE WHEN len(cited) = 0 THEN CASE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(cited, list_distinct(gold))) / len(cited)::DOUBLE END::DOUBLE AS correctness, CASE WHEN len(gold) = 0 THEN CASE WHEN len(cited) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(cited, list_distinct(gold))) / len(list_distinct(gold))::DOUBLE END::DOUBLE AS completeness FROM j")
def citation_metrics(spark, d):
    """Logged citations against the questions' gold chunks, numbered by id; 240 questions."""
    from pyspark.sql.window import Window

    g = table(spark, d, "eval_questions").select(F.row_number().over(Window.orderBy("id")).cast("long").alias("query_id"), F.transform("expected_source_chunks", lambda x: x.cast("long")).alias("gold"))
    c = table(spark, d, "citations").select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.collect_list("chunk_id").alias("cited"))
    j = g.join(c, "query_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>")))
    return j.select("query_id", *evaluation.citation_metrics(F.col("cited"), F.col("gold")))


_H1 = f"{_SEED}, {_NAMED}, h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT DISTINCT s.query_id, e.* FROM edges e JOIN seeds s ON s.entity_id = e.source_entity_id OR s.entity_id = e.target_entity_id)) WHERE n <= 20)"


def _graph_row(spark, d):
    seeds = _seeds(spark, d)
    hop = materialize(graph_query.hop1(_edges(spark, d), seeds, 20, table(spark, d, "entities")))
    g = hop.filter("chunk_id IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("graph"))
    keys = hop.groupBy("query_id").agg(F.collect_set(F.concat_ws("|", F.lower(F.trim("source_name")), "relationship_type", F.lower(F.trim("target_name")))).alias("edges"))
    n = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("seeds"))
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.transform("expected_relationships", lambda r: F.concat_ws("|", F.lower(F.trim(r["source"])), F.upper(F.trim(r["type"])), F.lower(F.trim(r["target"])))).alias("wanted"))
    j = _with_found(spark, d, _vector(spark, d, 10, False)).join(g, "query_id", "left").join(keys, "query_id", "left").join(n, "query_id", "left").join(q, "query_id")
    none, empty = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return j.select("query_id", "gold", "found", F.coalesce("graph", none).alias("graph"), F.coalesce("edges", empty).alias("edges"), F.coalesce("wanted", empty).alias("wanted"), F.coalesce("seeds", F.lit(0)).alias("seeds"))


@query(f"""WITH {cosine(10, False)}, {_H1}, {_GOLD}, {_sql_found('vec')},
    g AS (SELECT query_id, list(DISTINCT chunk_id) AS graph FROM h1 WHERE chunk_id IS NOT NULL GROUP BY query_id), k AS (SELECT query_id, list(DISTINCT lower(trim(source_name)) || '|' || relationship_type || '|' || lower(trim(target_name))) || list(DISTINCT lower(trim(target_name)) || '|' || relationship_type || '|' || lower(trim(source_name))) AS edges FROM h1 GROUP BY query_id),
    j AS (SELECT f.*, coalesce(g.graph, []) AS graph, coalesce(k.edges, []) AS edges, (SELECT count(*) FROM seeds s WHERE s.query_id = f.query_id) AS seeds, list_transform(e.expected_relationships, lambda r: lower(trim(r.source)) || '|' || upper(trim(r.type)) || '|' || lower(trim(r.target))) AS wanted FROM f LEFT JOIN g USING (query_id) LEFT JOIN k USING (query_id) JOIN eval_questions e ON e.id = f.query_id)
    SELECT query_id, CASE WHEN seeds > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS seed_hit, CASE WHEN len(wanted) = 0 THEN 0.0 ELSE len(list_filter(wanted, lambda x: list_contains(edges, x))) / len(wanted)::DOUBLE END::DOUBLE AS relationship_rate,
    CASE WHEN len(gold) = 0 THEN CASE WHEN len(graph) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(graph, gold)) / len(list_distinct(gold))::DOUBLE END::DOUBLE AS provenance_coverage,
    CASE WHEN len(list_distinct(found || graph)) = 0 THEN 0.0 ELSE len(list_intersect(found, graph)) / len(list_distinct(found || graph))::DOUBLE END::DOUBLE AS overlap_rate,
    len(list_filter(graph, lambda x: NOT list_contains(found, x))) AS unique_graph, len(list_filter(graph, lambda x: NOT list_contains(found, x) AND list_contains(gold, x))) AS unique_relevant FROM j""")
def graph_metrics(spark, d):
    j = _graph_row(spark, d)
    return j.select("query_id", *evaluation.graph_metrics(F.col("found"), F.col("graph"), F.col("gold"), F.col("seeds"), F.col("wanted"), F.col("edges")))


_LOW = "lower(trim(expected_answer, ' '))"
_SAID = f"list_filter(list_transform(string_split_regex({_LOW}, '[.!?\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 15)"
_W = "list_filter(regexp_extract_all(s, '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)"


@query(f"""WITH c AS (SELECT e.id AS query_id, e.expected_answer, e.expected_entities, e.category = 'no_evidence' AS none, lower(coalesce(string_agg(k.content, ' ' ORDER BY k.id), '')) AS ctx FROM eval_questions e LEFT JOIN chunks k ON list_contains(e.expected_source_chunks, k.id::INT) GROUP BY ALL),
    m AS (SELECT query_id, none, regexp_matches({_LOW}, 'not provide sufficient information|insufficient information|does not contain|no evidence|not mentioned|unsupported') AS refused, CASE WHEN len(expected_entities) = 0 THEN 1.0 ELSE len(list_filter(expected_entities, lambda x: contains({_LOW}, lower(x)))) / len(expected_entities)::DOUBLE END AS cov,
    CASE WHEN len({_SAID}) = 0 THEN 1.0 ELSE len(list_filter({_SAID}, lambda s: len({_W}) > 0 AND len(list_filter({_W}, lambda w: contains(ctx, w))) >= 0.65 * len({_W}))) / len({_SAID})::DOUBLE END AS gr FROM c)
    SELECT query_id, CASE WHEN none THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE cov END::DOUBLE AS entity_coverage, CASE WHEN none THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS refusal_correctness, CASE WHEN none THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE gr END::DOUBLE AS groundedness, CASE WHEN none THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE cov * 0.7 + gr * 0.3 END::DOUBLE AS answer_correctness FROM m""")
def generation_metrics(spark, d):
    """The expected answers against their own gold chunks."""
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), "expected_answer", "expected_entities", (F.col("category") == "no_evidence").alias("none"), F.explode_outer(F.transform("expected_source_chunks", lambda x: x.cast("long"))).alias("cid"))
    c = table(spark, d, "chunks").select(F.col("id").alias("cid"), "content")
    j = q.join(c, "cid", "left").groupBy("query_id", "expected_answer", "expected_entities", "none").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("cid", "content")))), lambda x: x["content"]), " ").alias("ctx"))
    return j.select("query_id", *evaluation.generation_metrics(F.col("expected_answer"), F.col("expected_entities"), F.col("ctx"), F.col("none")))


@query("SELECT e.id AS query_id, c.id AS chunk_id FROM (SELECT DISTINCT id, lower(unnest(expected_entities)) AS name FROM eval_questions) e JOIN chunks c ON contains(lower(c.content), e.name) WHERE length(e.name) > 0 GROUP BY ALL")
def gold_mapping(spark, d):
    """Chunks that hold an expected entity: the questions' names, a stated set, are looked up in every chunk by one automaton per worker."""
    from skein.operators.gold import contained

    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.explode("expected_entities").alias("name"))
    return contained(table(spark, d, "chunks"), "id", "content", q)
