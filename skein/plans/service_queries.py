"""Queries of readers, writers, streams, prompts and the other parts of the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import context, store
from skein.session import materialize, scratch_dir
from skein.sources import loaders, sinks
from skein.sources.tables import table
from skein.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WS = "[\\t\\n\\x0b\\f\\r ]"
_STRIP = "regexp_replace({}, '^" + _WS + "+|" + _WS + "+$', '', 'g')"
_PARAGRAPHS = f"list_filter(list_transform(string_split_regex(text, '\\n{_WS}*\\n'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0)"


@query(f"""WITH p AS (SELECT doc_id, unnest({_PARAGRAPHS}) AS p FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, CASE WHEN contains(p, chr(10)) THEN NULL WHEN regexp_matches(p, '^#{{1,6}}{_WS}+.+$') THEN {_STRIP.format(f"regexp_extract(p, '^#{{1,6}}{_WS}+(.+)$', 1)")} WHEN regexp_matches(p, '[A-Za-z]') AND (regexp_full_match(p, '[A-Z0-9\\t\\n\\x0b\\f\\r \\-_:]{{3,50}}:?') OR regexp_full_match(p, '[0-9]+\\.[0-9]*{_WS}+[A-Z].*')) THEN {_STRIP.format('p')} END AS heading FROM p)
    SELECT doc_id, heading, count(*) AS n FROM h WHERE heading IS NOT NULL GROUP BY ALL""")
def headings(spark, d):
    """Titles of the documents' paragraphs that are headings."""
    p = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return p.select("doc_id", T.heading(F.col("p")).alias("heading")).filter("heading IS NOT NULL").groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, len(list_filter(string_split_regex({_STRIP.format('content')}, '{_WS}+'), lambda w: w != '')) AS n_words FROM chunks WHERE content IS NOT NULL")
def word_counts(spark, d):
    return table(spark, d, "chunks").filter("content IS NOT NULL").select("id", T.word_count(F.col("content")).alias("n_words"))


@query("SELECT id, regexp_replace('key AIza' || substr(sha256(id), 1, 20 + length(id) % 7 * 3) || ' of ' || id, 'AIza[0-9A-Za-z\\-_]{35}', '[REDACTED_API_KEY]', 'g') AS message FROM eval_questions")
def redacted_messages(spark, d):
    """Messages with keys, some of them too short to be one."""
    message = F.concat(F.lit("key AIza"), F.substring(F.sha2("id", 256), F.lit(1), 20 + F.length("id") % 7 * 3), F.lit(" of "), F.col("id"))
    return table(spark, d, "eval_questions").select("id", T.redact(message).alias("message"))


@query("SELECT id, " + " OR ".join(f"contains(lower(coalesce(expected_answer, '')), '{p}')" for p in (context.NO_EVIDENCE.lower(), *context.REFUSALS)) + " AS refusal FROM eval_questions")
def refusals(spark, d):
    return table(spark, d, "eval_questions").select("id", context.is_refusal(F.col("expected_answer")).alias("refusal"))


@query("SELECT query_id, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS tags FROM citations GROUP BY query_id")
def source_tags(spark, d):
    """Numbers of the source tags in answers that cite all logged sources."""
    said = table(spark, d, "citations").groupBy("query_id").agg(F.array_join(F.collect_list(F.concat(F.lit("see [SOURCE "), F.col("source_id").cast("string"), F.lit("]"))), " and ").alias("a"))
    return said.select("query_id", F.array_join(F.transform(context.source_tags(F.col("a")), lambda x: x.cast("string")), ",").alias("tags"))


@query("SELECT id AS query_id, sha256('RETRIEVED CONTEXT:' || chr(10) || repeat('=', 80) || chr(10) || CASE WHEN length(trim(coalesce(notes, ''), ' ')) > 0 THEN trim(notes, ' ') ELSE 'No relevant context found.' END || chr(10) || repeat('=', 80) || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || trim(question, ' ') || chr(10) || chr(10) || 'ANSWER (Grounded strictly in the retrieved context above, with [SOURCE X] citations):') AS prompt FROM eval_questions")
def prompts(spark, d):
    """The questions' notes as contexts."""
    q = table(spark, d, "eval_questions")
    return q.select(F.col("id").alias("query_id"), F.sha2(context.prompt(F.col("question"), F.col("notes")), 256).alias("prompt"))


@query("SELECT doc_id, filename, department FROM documents WHERE filename = (SELECT filename FROM documents WHERE doc_id = 5)")
def documents_by_name(spark, d):
    """Rows of one file name, which ingestion may have stored more than once."""
    docs = table(spark, d, "documents")
    name = loaders.point_lookup(docs, doc_id=5).first()
    return loaders.point_lookup(docs, filename=f" {name.filename} ").select("doc_id", "filename", "department")


@query("SELECT id, chunk_index, row_number() OVER (ORDER BY chunk_index, id) AS n FROM chunks WHERE document_id = 7")
def chunks_of_document(spark, d):
    """One document's chunks in their order."""
    ids = [r.id for r in loaders.document_chunks(table(spark, d, "chunks").select("id", "document_id", "chunk_index"), 7).collect()]
    place = spark.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "id long, n long")
    return table(spark, d, "chunks").select("id", "chunk_index").join(place, "id")


@query("SELECT id, question, lower(trim(category, ' ')) AS category, expected_answer, len(expected_entities) AS n_entities, len(expected_relationships) AS n_relationships, len(expected_source_chunks) AS n_chunks, len(expected_pages) AS n_pages, notes FROM eval_questions")
def questions_loaded(spark, d):
    """The questions, written as an evaluation set and read again."""
    path = scratch_dir(spark)
    q = table(spark, d, "eval_questions").withColumn("category", F.lower(F.trim("category")))
    q.agg(F.collect_list(F.struct(*q.columns)).alias("questions")).write.json(path)
    got = loaders.load_questions(spark, path)
    return got.select("id", "question", "category", "expected_answer", *[F.size(f"expected_{c}").alias(f"n_{n}") for c, n in (("entities", "entities"), ("relationships", "relationships"), ("source_chunks", "chunks"), ("pages", "pages"))], "notes")


@query("SELECT 'c' || id AS chunk_id, 'doc_' || document_id AS document_id, content AS text, page_number, section, chunk_index, length(content) AS char_count FROM chunks")
def chunks_written(spark, d):
    """The chunks, written as JSON objects and read again."""
    path = scratch_dir(spark)
    c = table(spark, d, "chunks")
    meta = F.struct(F.lit(None).cast("string").alias("document_name"), F.lit("md").alias("file_type"), "page_number", "section", "chunk_index", F.length("content").alias("char_count"), F.lit(0).alias("word_count"))
    sinks.write_chunks(c.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.concat(F.lit("doc_"), F.col("document_id").cast("string")).alias("document_id"), F.col("content").alias("text"), meta.alias("metadata"), "embedding"), path)
    got = spark.read.schema(loaders.CHUNK_SCHEMA).json(path)
    return got.select("chunk_id", "document_id", "text", "metadata.page_number", "metadata.section", "metadata.chunk_index", "metadata.char_count")


@query("SELECT id AS chunk_id, document_id, length(content) AS n_chars FROM chunks WHERE content IS NOT NULL AND length(trim(content, ' ')) > 0")
def stream_ingest(spark, d):
    """Chunks taken by a stream in one run, and none by a second run over the same files."""
    path = scratch_dir(spark)
    table(spark, d, "chunks").select("id", "document_id", "content", "page_number").write.parquet(f"{path}/in")
    take = lambda b: b.filter("content IS NOT NULL AND length(trim(content)) > 0").select(F.col("id").alias("chunk_id"), "document_id", F.length("content").alias("n_chars"))
    for _ in range(2):
        ingest.run_available(spark, f"{path}/in", ingest.CHUNKS, take, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").drop("batch")


_NOW = "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC, attempts DESC) AS rn FROM chunk_progress WHERE chunk_id IS NOT NULL) WHERE rn = 1)"


@query(f"WITH {_NOW} SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'completed' WHEN chunk_id % 3 = 1 THEN 'failed' ELSE status END AS status, attempts + CASE WHEN chunk_id % 3 < 2 THEN 1 ELSE 0 END AS attempts FROM now")
def checkpoint_mark(spark, d):
    """States after a batch in which a third of the chunks was completed and a third failed."""
    now = materialize(store.current_progress(table(spark, d, "chunk_progress")))
    done = now.filter("chunk_id % 3 < 2").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, "completed").otherwise("failed").alias("new_status"))
    return store.mark(now, done).select("chunk_id", "status", "attempts")


@query("SELECT 'documents' AS name, 0::BIGINT AS n UNION ALL SELECT 'chunks', 0 UNION ALL SELECT 'relationships', 0")
def reset_tables(spark, d):
    """Rows that a reset leaves, with every table's schema kept."""
    parts = []
    for name in ("documents", "chunks", "relationships"):
        t = table(spark, d, name)
        empty = store.empty_like(t)
        assert empty.schema == t.schema
        parts.append(empty.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

