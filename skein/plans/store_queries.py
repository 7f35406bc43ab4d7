"""Queries of the table operations and the extraction checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import store
from skein.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _new_entities(e):
    """A second delivery: names in another order of time, the odd ones with a new display name."""
    meta = F.map_concat(F.map_filter("metadata", lambda k, v: k != "batch"), F.create_map(F.lit("batch"), F.lit("2")))
    return e.select((F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") % 2 == 0, F.col("canonical_name")).otherwise(F.concat("canonical_name", F.lit(" II"))).alias("canonical_name"), "entity_type", F.concat(F.trim("display_name"), F.lit("*")).alias("display_name"), meta.alias("metadata"), "created_at", "updated_at")


@query("""WITH n AS (SELECT id + 1000000 AS id, CASE WHEN id % 2 = 0 THEN canonical_name ELSE canonical_name || ' II' END AS canonical_name, entity_type, trim(display_name) || '*' AS display_name, 1 AS gen FROM entities),
    u AS (SELECT trim(canonical_name, ' ') AS canonical_name, trim(entity_type, ' ') AS entity_type, id, display_name, gen, metadata IS NOT NULL AS has, list_sort(list_distinct(map_keys(metadata))) AS ks FROM (SELECT id, canonical_name, entity_type, display_name, 0 AS gen, metadata FROM entities)
        UNION ALL SELECT trim(n.canonical_name, ' '), trim(n.entity_type, ' '), n.id, n.display_name, 1, true, list_sort(list_distinct(list_append(map_keys(e.metadata), 'batch'))) FROM n JOIN entities e ON e.id = n.id - 1000000)
    SELECT arg_min(id, gen) AS id, canonical_name, entity_type, arg_max(display_name, gen) AS display_name, array_to_string(list_sort(list_distinct(flatten(list(ks)))), ',') AS keys FROM u WHERE length(canonical_name) > 0 AND length(entity_type) > 0 GROUP BY canonical_name, entity_type""")
def entity_upsert(spark, d):
    e = table(spark, d, "entities")
    out = store.upsert_entities(e, _new_entities(e))
    return out.select("id", "canonical_name", "entity_type", "display_name", F.coalesce(F.array_join(F.array_sort(F.map_keys("metadata")), ","), F.lit("")).alias("keys"))


@query("""WITH u AS (SELECT id, source_entity_id AS s, target_entity_id AS t, relationship_type AS y, chunk_id AS c, document_id, page_number, metadata, created_at, updated_at, 0 AS gen, FALSE AS again FROM relationships
        UNION ALL SELECT id + 10000000, source_entity_id, target_entity_id, relationship_type, chunk_id, document_id, page_number, metadata, created_at, updated_at + INTERVAL 1 DAY, 1, TRUE FROM relationships WHERE id % 3 = 0),
    kv AS (SELECT id, s, t, y, c, gen, CASE WHEN again AND e.key = 'batch' THEN NULL ELSE e.key END AS k, e.value AS v FROM (SELECT *, unnest(map_entries(metadata)) AS e FROM u) UNION ALL SELECT id, s, t, y, c, gen, 'batch', '2' FROM u WHERE again),
    l AS (SELECT id, s, t, y, c, gen, k, v FROM kv WHERE k IS NOT NULL),
    m AS (SELECT s, t, y, c, string_agg(k || '=' || coalesce(v, ''), ';' ORDER BY k) AS metadata FROM (SELECT * FROM l WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s, t, y, c, k ORDER BY gen DESC, id DESC) = 1) GROUP BY ALL),
    f AS (SELECT id, string_agg(k || '=' || coalesce(v, ''), ';' ORDER BY k) AS metadata FROM l WHERE c IS NULL GROUP BY id),
    o AS (SELECT *, row_number() OVER (PARTITION BY s, t, y, c ORDER BY gen, id) AS n, max(updated_at) OVER (PARTITION BY s, t, y, c) AS latest FROM u WHERE c IS NOT NULL)
    SELECT id, s AS source_entity_id, t AS target_entity_id, y AS relationship_type, c AS chunk_id, document_id, page_number, coalesce(m.metadata, '') AS metadata, epoch_us(created_at) AS created_us, epoch_us(latest) AS updated_us FROM o LEFT JOIN m USING (s, t, y, c) WHERE n = 1
    UNION ALL SELECT u.id, s, t, y, c, document_id, page_number, coalesce(f.metadata, ''), epoch_us(created_at), epoch_us(updated_at) FROM u LEFT JOIN f ON f.id = u.id WHERE c IS NULL""")
def relationship_upsert(spark, d):
    """A third of the facts stored again under new ids, a day later and with an entry more."""
    r = table(spark, d, "relationships")
    meta = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "batch"), F.create_map(F.lit("batch"), F.lit("2")))
    again = r.filter("id % 3 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn("metadata", meta).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return store.upsert_relationships(r, again).select("id", "source_entity_id", "target_entity_id", "relationship_type", "chunk_id", "document_id", "page_number", text.alias("metadata"), F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT id, document_id, replace(CASE WHEN id % 3 = 0 THEN coalesce(content, '') WHEN id % 3 = 1 THEN coalesce('~' || content, '') ELSE '' END, chr(0), '') AS content, CASE WHEN id % 2 = 0 THEN coalesce(page_number, 7) ELSE 7 END AS page_number, coalesce(section, 'top') AS section, CASE WHEN id % 5 = 0 THEN 0 ELSE chunk_index END AS chunk_index FROM chunks WHERE embedding IS NULL OR len(embedding) = 384")
def insert_chunks(spark, d):
    """Chunk records whose fields stand in their metadata, beside it, or nowhere."""
    c = table(spark, d, "chunks").filter(F.col("embedding").isNull() | (F.size("embedding") == 384))
    records = c.select("id", "document_id", F.when(F.col("id") % 3 == 0, F.col("content")).alias("text"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("~"), "content")).alias("content"), F.struct(F.when(F.col("id") % 2 == 0, F.col("page_number")).alias("page_number"), "section").alias("metadata"), F.lit(7).alias("page_number"), F.lit("top").alias("section"), F.when(F.col("id") % 5 != 0, F.col("chunk_index")).alias("chunk_index"), "embedding", "created_at")
    return store.insert_chunks(records).select("id", "document_id", "content", "page_number", "section", "chunk_index")


@query("""WITH r AS (SELECT 'doc_' || c.document_id AS document_key, c.id, CASE WHEN c.document_id % 4 != 0 THEN d.filename END AS name, CASE WHEN c.document_id % 3 = 0 THEN d.document_type END AS kind, CASE WHEN c.document_id % 2 = 0 THEN d.department END AS department, d.access_level, d.status FROM chunks c JOIN documents d ON d.doc_id = c.document_id),
    f AS (SELECT *, count(*) OVER (PARTITION BY document_key) AS n FROM r QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY id) = 1)
    SELECT document_key, id AS first_position, n AS n_chunks, coalesce(name, document_key || '.txt') AS filename, coalesce(kind, regexp_extract(coalesce(name, document_key || '.txt'), '\\.([^./]+)$', 1)) AS document_type, replace(document_key, 'doc_', '') AS content_hash, coalesce(department, 'public') AS department, coalesce(access_level, 'public') AS access_level, coalesce(status, 'active') AS status FROM f""")
def processed_documents(spark, d):
    """Documents with the attributes of their first chunk record."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "filename", "document_type", "department", "access_level", "status")
    odd = lambda k, c: F.when(F.col("document_id") % k == 0, F.col(c))
    meta = F.struct(F.when(F.col("document_id") % 4 != 0, F.col("filename")).alias("document_name"), odd(3, "document_type").alias("file_type"), odd(2, "department").alias("department"), "access_level", "status")
    r = table(spark, d, "chunks").select("id", "document_id").join(docs, "document_id").select("id", F.concat(F.lit("doc_"), F.col("document_id").cast("string")).alias("document_id"), meta.alias("metadata"))
    return store.processed_documents(r, "id")


@query("""WITH keep AS (SELECT id FROM entities WHERE entity_type != 'DATE')
    SELECT id, 'source_entity_id' AS missing FROM relationships WHERE source_entity_id NOT IN (SELECT id FROM keep) UNION ALL SELECT id, 'target_entity_id' FROM relationships WHERE target_entity_id NOT IN (SELECT id FROM keep)
    UNION ALL SELECT id, 'document_id' FROM relationships WHERE document_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT id, 'chunk_id' FROM relationships WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks)""")
def fk_violations(spark, d):
    """What would break if all dates were dropped from the entities."""
    return store.foreign_key_violations(table(spark, d, "relationships"), table(spark, d, "entities").filter("entity_type != 'DATE'"), table(spark, d, "documents"), table(spark, d, "chunks"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE status = 'archived'), c AS (SELECT id FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM gone)),
    dead AS (SELECT id FROM chunks WHERE document_id IN (SELECT doc_id FROM gone))
    SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM relationships WHERE document_id NOT IN (SELECT doc_id FROM gone) AND (chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM dead))) AS relationships""")
def cascade_delete(spark, d):
    docs, chunks, edges = (table(spark, d, t) for t in ("documents", "chunks", "relationships"))
    a, b, c = store.delete_documents(docs.filter("status = 'archived'").select("doc_id"), docs, chunks, edges)
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return count(a, "documents").join(count(b, "chunks")).join(count(c, "relationships"))


@query("SELECT doc_id, CASE WHEN doc_id = 7 THEN 'finance' ELSE department END AS department, CASE WHEN doc_id = 7 THEN 'manager' ELSE access_level END AS access_level, CASE WHEN doc_id = 7 THEN 'active' ELSE status END AS status FROM documents")
def update_access(spark, d):
    return store.update_access(table(spark, d, "documents"), 7, "finance", "manager").select("doc_id", "department", "access_level", "status")


_NOW = "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC, attempts DESC) AS rn FROM chunk_progress WHERE chunk_id IS NOT NULL) WHERE rn = 1)"


@query(f"WITH {_NOW} SELECT chunk_id, document_id, page_number FROM now WHERE status = 'pending' OR (status = 'failed' AND attempts < 3) ORDER BY chunk_id LIMIT 25")
def checkpoint_pending(spark, d):
    return store.pending_batch(store.current_progress(table(spark, d, "chunk_progress")))


@query(f"WITH {_NOW} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped_empty') AS skipped_empty, coalesce(sum(entity_count) FILTER (status = 'completed'), 0)::BIGINT AS total_entities, coalesce(sum(relationship_count) FILTER (status = 'completed'), 0)::BIGINT AS total_relationships, coalesce(sum(input_tokens) FILTER (status = 'completed'), 0)::BIGINT AS total_input_tokens, coalesce(sum(output_tokens) FILTER (status = 'completed'), 0)::BIGINT AS total_output_tokens, coalesce(sum(attempts), 0)::BIGINT AS total_attempts FROM now")
def checkpoint_summary(spark, d):
    return store.progress_summary(store.current_progress(table(spark, d, "chunk_progress")))


@query("SELECT id AS chunk_id, document_id, page_number, 'pending' AS status FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_progress WHERE chunk_id IS NOT NULL)")
def checkpoint_register(spark, d):
    return store.register_chunks(store.current_progress(table(spark, d, "chunk_progress")), table(spark, d, "chunks"))


@query(f"WITH {_NOW} SELECT chunk_id, CASE WHEN status IN ('processing', 'failed') THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM now")
def checkpoint_reset(spark, d):
    return store.reset_states(store.current_progress(table(spark, d, "chunk_progress")), failed_like="").select("chunk_id", "status", "attempts")


@query("SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS text FROM chunks GROUP BY document_id")
def document_reconstruction(spark, d):
    return store.reconstruct(table(spark, d, "chunks").select("document_id", "chunk_index", "id", "content"))


@query("SELECT document_id, min(id) AS first_position, count(*) AS n_chunks FROM chunks GROUP BY document_id")
def documents_of_chunks(spark, d):
    return store.documents_of_chunks(table(spark, d, "chunks"))
