"""Tables as values: upserts, updates, deletes and the extraction checkpoint.

Each function returns the new content of a table; nothing is written over a
path that is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialize

DIM = 384


def clean_text(c: Column) -> Column:
    return F.regexp_replace(c, "\\x00", "")


def insert_documents(new: DataFrame, first_id: int = 1) -> DataFrame:
    """Rows to append: NUL bytes dropped, blank access columns at their defaults, ids from first_id on, rising but not dense.

    A re-ingested document is a new row.
    """
    blank = lambda c, default: F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, F.lit(default)).otherwise(F.trim(clean_text(F.col(c)))).alias(c)
    rows = new.select(clean_text(F.col("filename")).alias("filename"), clean_text(F.col("document_type")).alias("document_type"), "content_hash", blank("department", "public"), blank("access_level", "public"), blank("status", "active"))
    return rows.withColumn("id", F.lit(first_id).cast("long") + F.monotonically_increasing_id()).select("id", *rows.columns)


def _field(df: DataFrame, name: str, inside: str = "metadata") -> Column:
    """A chunk record's field: of its metadata if it is there and not null, else of the record itself, else null."""
    parts = []
    if inside in df.columns and name in getattr(df.schema[inside].dataType, "names", []):
        parts.append(F.col(f"{inside}.{name}"))
    if name in df.columns:
        parts.append(F.col(name))
    return F.coalesce(*parts) if parts else F.lit(None)


def insert_chunks(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows to append; a vector of another length than dim fails the job, a null one is kept.

    The content is a record's text or else its content, empty if both are
    null; page, section and index come from its metadata or else the record
    (index 0 if neither has one).
    """
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit(f"embedding of a length other than {dim} in chunk "), F.col("id").cast("string"))).cast("array<float>")).otherwise(F.col("embedding"))
    text = F.coalesce(*[F.col(c) for c in ("text", "content") if c in chunks.columns], F.lit(""))
    made = F.col("created_at") if "created_at" in chunks.columns else F.current_timestamp()
    return chunks.select("id", "document_id", clean_text(text).alias("content"), _field(chunks, "page_number").cast("int").alias("page_number"), clean_text(_field(chunks, "section").cast("string")).alias("section"), F.coalesce(_field(chunks, "chunk_index").cast("int"), F.lit(0)).alias("chunk_index"), checked.alias("embedding"), made.alias("created_at"))


def processed_documents(records: DataFrame, position: str) -> DataFrame:
    """(document_key, first_position, n_chunks, filename, document_type, content_hash, department, access_level, status): one row per document_id of chunk records, with the attributes of its first chunk by `position`.

    A missing name is the key with .txt, a missing type the name's ending, a
    missing access column its default; the hash is the key without doc_.
    """
    names = ("document_name", "file_type", "department", "access_level", "status")
    first = F.min_by(F.struct(*[_field(records, n).cast("string").alias(n) for n in names]), F.col(position))
    g = records.groupBy(F.col("document_id").alias("document_key")).agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("n_chunks"), first.alias("m"))
    name = F.coalesce("m.document_name", F.concat("document_key", F.lit(".txt")))
    blank = lambda c, default: F.coalesce(F.col(f"m.{c}"), F.lit(default)).alias(c)
    kind = F.coalesce("m.file_type", F.regexp_extract(name, r"\.([^./]+)$", 1))
    return g.select("document_key", "first_position", "n_chunks", name.alias("filename"), kind.alias("document_type"), F.replace("document_key", F.lit("doc_"), F.lit("")).alias("content_hash"), blank("department", "public"), blank("access_level", "public"), blank("status", "active"))


def documents_of_chunks(chunks: DataFrame) -> DataFrame:
    """(document_id, first_position, n_chunks): documents in the order in which their chunks come, with their number of chunks."""
    return chunks.groupBy("document_id").agg(F.min("id").alias("first_position"), F.count(F.lit(1)).alias("n_chunks"))


def _merged_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metadata): the last value of each entry by seq; entries are reduced to it before they are gathered."""
    entries = rows.select(*keys, "seq", F.explode_outer("metadata").alias("k", "v")).filter(F.col("k").isNotNull())
    last = entries.groupBy(*keys, "k").agg(F.max_by(F.struct("v"), "seq").alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v.v")))).alias("metadata"))


def upsert_entities(current: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by (canonical_name, entity_type), letter case counting: the newest display name, metadata merged in order, the first id and created_at.

    Both have id, canonical_name, entity_type, display_name, metadata,
    created_at, updated_at; rows of `new` come after those of `current`, each
    in the order of (updated_at, id).  Blank keys are dropped.  The metadata
    entries are reduced to the last of each key before they are gathered.
    """
    cols = ["id", "canonical_name", "entity_type", "display_name", "metadata", "created_at", "updated_at"]
    every = current.select(*cols, F.lit(0).alias("gen")).unionByName(new.select(*cols, F.lit(1).alias("gen")))
    trimmed = every.withColumn("canonical_name", F.trim("canonical_name")).withColumn("entity_type", F.trim("entity_type"))
    trimmed = trimmed.filter((F.length("canonical_name") > 0) & (F.length("entity_type") > 0)).withColumn("seq", F.struct("gen", "updated_at", "id"))
    keys = ["canonical_name", "entity_type"]
    meta = _merged_metadata(trimmed, keys)
    head = trimmed.groupBy(*keys).agg(F.min_by("id", "seq").alias("id"), F.max_by("display_name", "seq").alias("display_name"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return head.join(meta, keys, "left").select(*cols)


def upsert_relationships(current: DataFrame, new: DataFrame) -> DataFrame:
    """Facts by (source, target, type, chunk): stored once per chunk, the first id, document, page and created_at kept, metadata merged in order, the last updated_at.

    Rows of `new` come after those of `current`, each by id.  Facts without a
    chunk are never equal and are all kept.
    """
    cols = ["id", "source_entity_id", "target_entity_id", "relationship_type", "document_id", "chunk_id", "page_number", "metadata", "created_at", "updated_at"]
    every = current.select(*cols, F.lit(0).alias("gen")).unionByName(new.select(*cols, F.lit(1).alias("gen")))
    free = every.filter(F.col("chunk_id").isNull()).select(*cols)
    keys = ["source_entity_id", "target_entity_id", "relationship_type", "chunk_id"]
    rows = every.filter(F.col("chunk_id").isNotNull()).withColumn("seq", F.struct("gen", "id"))
    once = rows.groupBy(*keys).agg(*[F.min_by(c, "seq").alias(c) for c in ("id", "document_id", "page_number", "created_at")], F.max("updated_at").alias("updated_at"))
    return once.join(_merged_metadata(rows, keys), keys, "left").select(*cols).unionByName(free)


def foreign_key_violations(edges: DataFrame, entities: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, missing): edges whose source, target, document or chunk does not exist; a null chunk is no violation."""
    checks = (("source_entity_id", entities, "id"), ("target_entity_id", entities, "id"), ("document_id", documents, "doc_id"), ("chunk_id", chunks, "id"))
    out = None
    for column, other, key in checks:
        bad = edges.filter(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti").select("id", F.lit(column).alias("missing"))
        out = bad if out is None else out.unionByName(bad)
    return out


def resolve_relationships(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, ...) of relations by name: a name means the entity with that canonical or display name, letter case aside, the last one if several; unresolved ones are left out."""
    names = entities.select("id", F.explode(F.array(F.lower(F.trim("canonical_name")), F.lower(F.trim("display_name")))).alias("k")).groupBy("k").agg(F.max("id").alias("id"))
    s = names.select(F.col("k").alias("_s"), F.col("id").alias("source_entity_id"))
    t = names.select(F.col("k").alias("_t"), F.col("id").alias("target_entity_id"))
    return relations.withColumn("_s", F.lower(F.trim("source"))).withColumn("_t", F.lower(F.trim("target"))).join(s, "_s").join(t, "_t").drop("_s", "_t")


def chunk_graph(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, counts) of extraction results (chunk_id, document_id, page_number, x), x holding entities and relationships.

    A relationship's ends are names of the chunk's own entities, canonical or
    as written, letter case aside, the last one if several; one with an
    unknown end is left out.  entities (chunk_id, pos, canonical_name,
    entity_type, display_name, metadata), relationships (chunk_id, pos,
    document_id, page_number, source and target as (canonical_name,
    entity_type), relationship_type, metadata), counts (chunk_id,
    entities_upserted, relationships_inserted) of every chunk, also of those
    with neither.
    """
    e = extractions.select("chunk_id", F.posexplode("x.entities").alias("pos", "e"))
    name = F.trim(F.col("e.name"))
    canonical = F.coalesce(F.nullif(F.trim(F.col("e.canonical_name")), F.lit("")), name)
    meta = lambda x, f: F.map_from_arrays(F.array(F.lit(f), F.lit("confidence")), F.array(F.col(f"{x}.{f}"), F.col(f"{x}.confidence").cast("string")))
    entities = e.select("chunk_id", "pos", canonical.alias("canonical_name"), F.col("e.entity_type").alias("entity_type"), name.alias("display_name"), meta("e", "description").alias("metadata")).filter(F.length("canonical_name") > 0)
    known = entities.select("chunk_id", F.posexplode(F.array(F.lower("canonical_name"), F.lower("display_name"))).alias("sub", "k"), "pos", F.struct("canonical_name", "entity_type").alias("key"))
    known = known.filter(F.length("k") > 0).groupBy("chunk_id", "k").agg(F.max_by("key", F.struct("pos", "sub")).alias("key"))
    r = extractions.select("chunk_id", "document_id", "page_number", F.posexplode("x.relationships").alias("pos", "r"))
    end = lambda side: known.select("chunk_id", F.col("k").alias(f"_{side}"), F.col("key").alias(side))
    named = r.withColumn("_source", F.lower(F.trim("r.source"))).withColumn("_target", F.lower(F.trim("r.target"))).join(end("source"), ["chunk_id", "_source"]).join(end("target"), ["chunk_id", "_target"])
    relationships = named.select("chunk_id", "pos", "document_id", "page_number", "source", "target", F.col("r.relationship_type").alias("relationship_type"), meta("r", "evidence").alias("metadata"))
    counts = extractions.select("chunk_id", F.coalesce(F.size("x.entities"), F.lit(0)).cast("long").alias("entities_upserted"))
    inserted = relationships.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("relationships_inserted"))
    return entities, relationships, counts.join(inserted, "chunk_id", "left").withColumn("relationships_inserted", F.coalesce("relationships_inserted", F.lit(0).cast("long")))


def apply_chunk_graph(entities: DataFrame, relationships: DataFrame, extractions: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The new content of both tables after a batch of extraction results: new entities and facts with ids beyond the present ones, rising but not dense.

    Both come from the same batch, so a caller that writes them to a new
    version and then moves its pointer stores either all or nothing.
    """
    at = F.current_timestamp() if at is None else at
    new_e, new_r, _ = chunk_graph(extractions)
    free = lambda df: (df.agg(F.max("id")).first()[0] or 0) + 1
    rows = materialize(new_e.orderBy("chunk_id", "pos").select((F.lit(free(entities)) + F.monotonically_increasing_id()).alias("id"), "canonical_name", "entity_type", "display_name", "metadata", at.alias("created_at"), at.alias("updated_at")))
    after = materialize(upsert_entities(entities, rows))
    ids = after.select("id", F.struct("canonical_name", "entity_type").alias("key"))
    named = new_r.join(ids.select(F.col("id").alias("source_entity_id"), F.col("key").alias("source")), "source").join(ids.select(F.col("id").alias("target_entity_id"), F.col("key").alias("target")), "target")
    facts = materialize(named.orderBy("chunk_id", "pos").select((F.lit(free(relationships)) + F.monotonically_increasing_id()).alias("id"), "source_entity_id", "target_entity_id", "relationship_type", "document_id", "chunk_id", "page_number", "metadata", at.alias("created_at"), at.alias("updated_at")))
    return after, upsert_relationships(relationships, facts)


def update_access(documents: DataFrame, doc_id: int, department: str, access_level: str, status: str = "active") -> DataFrame:
    hit = F.col("doc_id") == doc_id
    for c, v in (("department", department), ("access_level", access_level), ("status", status)):
        documents = documents.withColumn(c, F.when(hit, F.lit(v)).otherwise(F.col(c)))
    return documents


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and relationships without the documents of `gone` (doc_id) and what depends on them, by either key."""
    d = gone.select(F.col("doc_id").alias("document_id")).distinct()
    left_chunks = chunks.join(d, "document_id", "left_anti")
    dead = chunks.join(d, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    left_edges = edges.join(d, "document_id", "left_anti").join(dead, "chunk_id", "left_anti")
    return documents.join(gone.select("doc_id").distinct(), "doc_id", "left_anti"), left_chunks, left_edges


def empty_like(df: DataFrame) -> DataFrame:
    """The table without rows, for a reset."""
    return df.sparkSession.createDataFrame([], df.schema)


def create_tables(spark: SparkSession, schemas: dict[str, str], fmt: str = "parquet") -> None:
    """Tables that don't exist yet."""
    for name, columns in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt}")


def current_progress(log: DataFrame) -> DataFrame:
    """One row per chunk: the newest recorded state, by updated_at, then loaded_at."""
    cols = [c for c in log.columns if c not in ("chunk_id", "updated_at", "loaded_at")]
    newest = log.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.struct("updated_at", "loaded_at", "status", "attempts", *[c for c in cols if c not in ("status", "attempts")])).alias("r"))
    return newest.select("chunk_id", *[f"r.{c}" for c in cols], "r.updated_at", "r.loaded_at")


def register_chunks(progress: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, page_number, status): pending rows for chunks that have none yet."""
    new = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number").join(progress.select("chunk_id"), "chunk_id", "left_anti")
    return new.withColumn("status", F.lit("pending"))


def pending_batch(progress: DataFrame, size: int = 25, max_attempts: int = 3) -> DataFrame:
    ready = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < max_attempts))
    return progress.filter(ready).orderBy("chunk_id").limit(size).select("chunk_id", "document_id", "page_number")


def reset_states(progress: DataFrame, processing: bool = True, failed_like: str | None = None) -> DataFrame:
    """States after a restart: processing becomes pending; failed ones whose message holds failed_like become pending with no attempts."""
    out = progress
    if processing:
        out = out.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))
    if failed_like is not None:
        hit = (F.col("status") == "failed") & F.coalesce(F.contains("error_message", F.lit(failed_like)), F.lit(failed_like == ""))
        out = out.select(*[F.when(hit, F.lit(v)).otherwise(F.col(c)).alias(c) if (v := {"status": "pending", "attempts": 0}.get(c)) is not None else (F.when(~hit, F.col(c)).alias(c) if c == "error_message" else F.col(c)) for c in out.columns])
    return out


def mark(progress: DataFrame, results: DataFrame) -> DataFrame:
    """States after a batch of (chunk_id, new_status): completed, failed and skipped_empty chunks count an attempt more."""
    j = progress.join(results.select("chunk_id", "new_status"), "chunk_id", "left")
    done = F.col("new_status").isNotNull()
    return j.withColumn("attempts", F.when(done, F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def progress_summary(progress: DataFrame) -> DataFrame:
    """One row of conditional sums over the states."""
    s = F.col("status")
    done = lambda c: F.coalesce(F.sum(F.when(s == "completed", F.col(c))), F.lit(0)).cast("long")
    states = ("completed", "pending", "processing", "failed", "skipped_empty")
    return progress.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == x).alias(x) for x in states], done("entity_count").alias("total_entities"), done("relationship_count").alias("total_relationships"), done("input_tokens").alias("total_input_tokens"), done("output_tokens").alias("total_output_tokens"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("total_attempts"))


def reconstruct(chunks: DataFrame) -> DataFrame:
    """(document_id, text): each document's chunks in the order of chunk_index, then id, with blank lines between them."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))
