"""Readers of raw files, chunk JSON and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import document_key, normalize_text

SUPPORTED = ("txt", "md", "pdf")
# Kinds of question.
CATEGORIES = ("direct_factual", "entity_relationship", "multi_hop_relationship", "comparison", "multiple_source_chunks", "vector_favored", "graph_favored", "no_evidence")

CHUNK_SCHEMA = "chunk_id string, document_id string, text string, metadata struct<document_name:string,file_type:string,page_number:int,section:string,chunk_index:int,char_count:int,word_count:int>, embedding array<float>"
QUESTION_SCHEMA = "id string, question string, category string, expected_answer string, expected_entities array<string>, expected_relationships array<struct<source:string,type:string,target:string>>, expected_source_chunks array<int>, expected_pages array<struct<document_id:int,page_number:int>>, notes string"


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content")


def load_text(spark: SparkSession, path: str, kind: str = "txt") -> DataFrame:
    """(document_key, filename, title, document_type, text, n_chars, file_size) of text files; bytes that are no UTF-8 are replaced."""
    f = _files(spark, path, kind)
    text = F.expr("make_valid_utf8(cast(content as string))")
    f = f.withColumn("text", text)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return f.select(document_key(F.col("text")).alias("document_key"), "filename", stem.alias("title"), F.lit(kind).alias("document_type"), "text", F.length("text").alias("n_chars"), "file_size")


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """As load_text; the title is the first first-level heading, or the file's name."""
    f = load_text(spark, path, "md")
    return f.withColumn("title", F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit("")), "title"))


def load_pdf(spark: SparkSession, path: str) -> DataFrame:
    """As load_text, with form feeds between pages; needs a PDF library on the executors, and raises without one."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package PyMuPDF") from e

    def run(batches):
        import fitz
        import pyarrow as pa

        for b in batches:
            names, texts, sizes = [], [], []
            for n, size, raw in zip(*(c.to_pylist() for c in b.columns)):
                with fitz.open(stream=raw, filetype="pdf") as doc:
                    texts.append("\f".join(p.get_text("text", sort=True) for p in doc))
                names.append(n), sizes.append(size)
            yield pa.RecordBatch.from_pydict({"filename": pa.array(names, pa.string()), "file_size": pa.array(sizes, pa.int64()), "text": pa.array(texts, pa.string())})

    f = _files(spark, path, "pdf").mapInArrow(run, "filename string, file_size long, text string").withColumn("text", _pages(F.col("text")))
    return f.select(document_key(F.col("text")).alias("document_key"), "filename", F.regexp_replace("filename", r"\.[^.]*$", "").alias("title"), F.lit("pdf").alias("document_type"), "text", F.length("text").alias("n_chars"), "file_size")


def _pages(c: Column) -> Column:
    """Each page's text normalised by itself; blank pages stay, so that pages keep their numbers."""
    return F.array_join(F.transform(F.split(c, "\f"), normalize_text), "\f")


def load_documents(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """All files of the given kinds in a folder; an unsupported kind raises."""
    readers = {"txt": load_text, "md": load_markdown, "pdf": load_pdf}
    unknown = [k for k in kinds if k not in readers]
    if unknown:
        raise ValueError(f"unsupported file types {unknown}; one of {SUPPORTED}")
    parts = [readers[k](spark, path) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_chunk_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of chunk objects."""
    return spark.read.schema(CHUNK_SCHEMA).json(path, multiLine=True)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: {"questions": [...]} or an array; a question of an unknown category fails the job that reads it."""
    whole = spark.read.schema(f"questions array<struct<{QUESTION_SCHEMA.replace(' string', ':string').replace(' array', ':array')}>>").json(path, multiLine=True)
    q = whole.filter("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*")
    bad = ~F.coalesce(F.col("category").isin(list(CATEGORIES)), F.lit(False))
    return q.withColumn("category", F.when(bad, F.raise_error(F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("null")))).cast("string")).otherwise(F.col("category")))


def multi_hop_sample(questions: DataFrame, n: int = 10) -> DataFrame:
    """The first n questions, by id, of (id, paragraphs array<struct<is_supporting boolean, ...>>) with at least two supporting paragraphs."""
    return questions.filter(F.size(F.filter("paragraphs", lambda p: p["is_supporting"])) >= 2).orderBy("id").limit(n)


def point_lookup(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values, text without spaces around it; the comparison is pushed down to the scan."""
    for c, v in values.items():
        df = df.filter(F.col(c) == (v.strip() if isinstance(v, str) else v))
    return df


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    return point_lookup(chunks, document_id=document_id).orderBy("chunk_index", "id")
