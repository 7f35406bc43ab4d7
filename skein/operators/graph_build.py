"""From extraction output to graph tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.ontology import entity_type, relationship_type
from skein.functions.text import canonicalize, redact

ENTITY = "struct<name:string,canonical_name:string,entity_type:string,description:string,confidence:double>"
RELATION = "struct<source:string,target:string,relationship_type:string,evidence:string,confidence:double>"
EXTRACTION = f"struct<entities:array<{ENTITY}>,relationships:array<{RELATION}>>"


def parse_extraction(c: Column) -> Column:
    """Extraction output as a struct; a code fence around it is dropped, '' gives an empty extraction, what is no JSON object gives null."""
    body = F.trim(F.coalesce(c, F.lit("")))
    fenced = F.regexp_extract(body, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(fenced != "", fenced).otherwise(body)
    body = F.when(body == "", F.lit("{}")).otherwise(body)
    ok = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
    return F.when(ok, F.from_json(body, EXTRACTION))


def extracted_entities(extractions: DataFrame) -> DataFrame:
    """(chunk_id, pos, name, canonical_name, entity_type, description, confidence) of (chunk_id, document_id, x); blank names and unknown types are left out."""
    e = extractions.select("chunk_id", F.posexplode("x.entities").alias("pos", "e"))
    canon = F.when(F.coalesce(F.col("e.canonical_name"), F.lit("")) != "", F.col("e.canonical_name")).otherwise(canonicalize(F.col("e.name"), F.col("e.entity_type")))
    e = e.select("chunk_id", "pos", F.trim("e.name").alias("name"), canon.alias("canonical_name"), entity_type(F.col("e.entity_type")).alias("entity_type"), F.nullif(F.col("e.description"), F.lit("")).alias("description"), F.col("e.confidence").alias("confidence"))
    e = e.filter((F.coalesce("name", F.lit("")) != "") & F.col("entity_type").isNotNull())
    return e.withColumn("canonical_name", F.when(F.col("canonical_name") == "", F.col("name")).otherwise(F.col("canonical_name")))


def unique_entities(entities: DataFrame) -> DataFrame:
    """One row per chunk, canonical name (letter case aside) and type: the first spelling, the highest confidence, the first description."""
    return entities.groupBy("chunk_id", F.lower("canonical_name").alias("key"), "entity_type").agg(
        F.min_by("canonical_name", "pos").alias("canonical_name"), F.min_by("name", "pos").alias("name"), F.max("confidence").alias("confidence"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("pos"))).alias("description"),
    ).drop("key")


def judged_relationships(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, pos, source, target, relationship_type, confidence, reason): every relationship with the reason for which it is dropped, null if it is kept.

    The reasons, in this order: source_not_found, target_not_found,
    self_referential, duplicate; a relationship of unknown type is invalid_type.
    Names are found by their surface or canonical form, letter case aside; of
    equal names the one registered last holds.
    """
    r = extractions.select("chunk_id", F.posexplode("x.relationships").alias("pos", "r")).select("chunk_id", "pos", "r.source", "r.target", relationship_type(F.col("r.relationship_type")).alias("relationship_type"), F.col("r.confidence").alias("confidence"))
    first = Window.partitionBy("chunk_id", F.lower("canonical_name"), "entity_type").orderBy("pos")
    kept = entities.withColumn("canon", F.first("canonical_name").over(first)).withColumn("new", F.row_number().over(first) == 1)
    by_name = kept.select("chunk_id", F.lower("name").alias("k"), "canon", F.struct("pos", F.lit(0)).alias("at"))
    by_canon = kept.filter("new").select("chunk_id", F.lower(F.trim("canonical_name")).alias("k"), "canon", F.struct("pos", F.lit(1)).alias("at"))
    names = by_name.unionByName(by_canon).groupBy("chunk_id", "k").agg(F.max_by("canon", "at").alias("canon"))
    side = lambda s: names.select(F.col("chunk_id"), F.col("k").alias(f"_{s}k"), F.col("canon").alias(f"_{s}"))
    j = r.withColumn("_sk", F.lower(F.trim("source"))).withColumn("_tk", F.lower(F.trim("target")))
    j = j.join(side("s"), ["chunk_id", "_sk"], "left").join(side("t"), ["chunk_id", "_tk"], "left")
    reason = F.when(F.col("relationship_type").isNull(), "invalid_type").when(F.col("_s").isNull(), "source_not_found").when(F.col("_t").isNull(), "target_not_found").when(F.lower("_s") == F.lower("_t"), "self_referential")
    j = j.withColumn("reason", reason)
    same = Window.partitionBy("chunk_id", F.lower("_s"), F.lower("_t"), "relationship_type", F.col("reason").isNull()).orderBy("pos")
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("reason")))
    return j.select("chunk_id", "pos", F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"), "relationship_type", "confidence", "reason")


def extract(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(chunk_id, document_id, raw, status, error) of (id, document_id, content): an injected model from text to JSON; an error is a row's status, with keys redacted."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, status, error = [], [], []
            for t in b.column(2).to_pylist():
                try:
                    blank = not (t or "").strip()
                    raw.append("" if blank else model(t)), status.append("skipped_empty" if blank else "success"), error.append(None)
                except Exception as e:
                    raw.append(None), status.append("error"), error.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.string()), pa.array(status, pa.string()), pa.array(error, pa.string())], names=["chunk_id", "document_id", "raw", "status", "error"])

    done = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "content").mapInArrow(run, "chunk_id long, document_id long, raw string, status string, error string")
    return done.withColumn("error", redact(F.col("error")))
