"""What several queries share: the caller, the questions, and SQL fragments that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.acl import AccessContext, acl_predicate
from skein.sources.tables import table

CALLER = AccessContext("engineering", "employee")


def allowed_documents(spark: SparkSession, d: str, ctx: AccessContext = CALLER) -> DataFrame:
    return table(spark, d, "documents").filter(acl_predicate(ctx)).select(F.col("doc_id").alias("document_id"))


def allowed_chunks(spark: SparkSession, d: str, ctx: AccessContext = CALLER) -> DataFrame:
    return table(spark, d, "chunks").join(allowed_documents(spark, d, ctx), "document_id", "left_semi").select("id")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each question: that of the first chunk that it expects."""
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.get("expected_source_chunks", F.lit(0)).cast("long").alias("cid"))
    return q.join(table(spark, d, "chunks").select(F.col("id").alias("cid"), "embedding"), "cid").select("query_id", "embedding")


ACL = "status = 'active' AND access_level IN ('public', 'employee') AND department IN ('public', 'engineering')"


def portable(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'Z', 'g')"


def tokens(c: str) -> str:
    return f"coalesce(regexp_extract_all({portable(c)}, '\\b[a-z0-9_-]+\\b'), [])"


def bm25(k: int, acl: bool, name: str = "bm25") -> str:
    """CTEs that end with one of the given name (query_id, id, score, rank)."""
    only = f"AND p.id IN (SELECT c.id FROM chunks c JOIN documents d ON d.doc_id = c.document_id WHERE {ACL})" if acl else ""
    return f"""
    {name}_t AS (SELECT id, {tokens('content')} AS t FROM chunks),
    {name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
    {name}_p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
    {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
    {name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT id AS query_id, unnest({tokens('question')}) AS term FROM eval_questions) GROUP BY ALL),
    {name}_r AS (SELECT q.query_id, p.id, sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))) AS raw
        FROM {name}_q q JOIN {name}_p p USING (term) JOIN {name}_d d USING (term) CROSS JOIN {name}_s s WHERE true {only} GROUP BY ALL),
    {name} AS (SELECT query_id, id, round(raw, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM {name}_r WHERE raw > 0) WHERE rank <= {k})"""




def cosine(k: int, acl: bool, name: str = "vec") -> str:
    only = f"AND document_id IN (SELECT doc_id FROM documents WHERE {ACL})" if acl else ""
    return f"""
    {name}_b AS (SELECT id, document_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM chunks WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    {name}_q AS (SELECT e.id AS query_id, b.v FROM eval_questions e JOIN {name}_b b ON b.id = e.expected_source_chunks[1]),
    {name}_r AS (SELECT q.query_id, b.id, 1 - list_cosine_similarity(b.v, q.v) AS d FROM {name}_q q CROSS JOIN {name}_b b WHERE true {only}),
    {name} AS (SELECT query_id, id, round(d, 4) AS distance, round(greatest(0, 1 - d), 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM {name}_r) WHERE rank <= {k})"""


def rrf(lists: list[tuple[str, str]], k: int, top: int, name: str = "rrf") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS pos, '{s}' AS source FROM {t}" for i, (s, t) in enumerate(lists))
    return f"""
    {name}_u AS ({union}),
    {name}_g AS (SELECT query_id, id, sum(1.0::DOUBLE / ({k} + rank)) AS raw, min({{'pos': pos, 'rank': rank}}) AS first, array_to_string(list_sort(list_distinct(list(source))), ',') AS retrieved_by FROM {name}_u GROUP BY ALL),
    {name} AS (SELECT query_id, id, round(raw, 6) AS rrf_score, rank, retrieved_by FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first, id) AS rank FROM {name}_g) WHERE rank <= {top})"""
