"""Structural chunking of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 800, 150
SEPARATOR = "\n\n"

_BLANK = re.compile(r"\n\s*\n")
_MARKED = re.compile(r"#{1,6}\s+(.+)$")
_PLAIN = re.compile(r"(?=.*[A-Za-z])(?:[A-Z0-9\s\-_:]{3,50}:?|[0-9]+\.[0-9]*\s+[A-Z].*)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than size")


def title_of(paragraph: str) -> str | None:
    if "\n" in paragraph:
        return None
    m = _MARKED.match(paragraph)
    if m:
        return m[1].strip()
    m = _PLAIN.match(paragraph)
    return m[0].strip() if m else None


def parts(paragraph: str, size: int) -> list[str]:
    """The paragraph if it fits; else its lines if they all do; else its sentences."""
    if len(paragraph) <= size:
        return [paragraph]
    lines = [x for x in map(str.strip, paragraph.split("\n")) if x]
    if len(lines) > 1 and max(map(len, lines)) <= size:
        return lines
    return [x for x in map(str.strip, _SENTENCE.split(paragraph)) if x]


@dataclass
class Packer:
    """Collects units into chunks of one section at a time."""

    size: int
    overlap: int
    section: str = "General"
    page: int | None = 1
    held: list[str] = field(default_factory=list)
    out: list[tuple[str, str, int | None]] = field(default_factory=list)

    def length(self, units: list[str]) -> int:
        return sum(map(len, units)) + len(SEPARATOR) * max(0, len(units) - 1)

    def emit(self, text: str) -> None:
        if text.strip():
            self.out.append((text.strip(), self.section, self.page))

    def flush(self, carry: bool = False) -> None:
        """Close the chunk; with carry, its longest tail of units within the overlap starts the next one."""
        if self.held:
            self.emit(SEPARATOR.join(self.held))
        k = len(self.held)
        while carry and k > 0 and self.length(self.held[k - 1 :]) <= self.overlap:
            k -= 1
        self.held = self.held[k:] if carry else []

    def add(self, unit: str) -> None:
        if self.held and self.length([*self.held, unit]) > self.size:
            self.flush(carry=True)
        if len(unit) <= self.size:
            self.held.append(unit)
            return
        # longer than a chunk: windows, and nothing is carried past them
        at, step = 0, self.size - self.overlap
        while True:
            self.emit(unit[at : at + self.size])
            if at + self.size >= len(unit):
                break
            at += step
        self.held = []


def chunk_pages(pages: list[tuple[int | None, str]], size: int = SIZE, overlap: int = OVERLAP, title: str = "General") -> list[tuple[str, str, int | None]]:
    """(text, section, page) of each chunk.  A heading starts a section, which lasts over page ends; no chunk crosses a page."""
    p = Packer(size, overlap, title)
    for number, text in pages:
        p.page = number
        for paragraph in filter(None, map(str.strip, _BLANK.split((text or "").strip()))):
            name = title_of(paragraph)
            if name:
                p.flush()
                p.section = name
            for unit in parts(paragraph, size):
                p.add(unit)
        p.flush()
    return p.out


def chunk_documents(documents: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, by_page: bool = False) -> DataFrame:
    """(document_id, chunk_index, chunk_id, content, section, page_number, char_count, word_count).

    Null and blank texts give no chunk.  With by_page, form feeds part pages.
    A chunk may be longer than `size` by the overlap that it starts with.
    Documents are chunked where they are read, without a shuffle.
    """
    check_sizes(size, overlap)
    schema = pa.schema([("document_id", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("section", pa.string()), ("page_number", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                pages = list(enumerate(t.split("\f"), 1)) if by_page else [(1, t)]
                rows += [(d, i, c, s, p) for i, (c, s, p) in enumerate(chunk_pages(pages, size, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    cut = documents.select(F.col(key).cast("string").alias("document_id"), F.col(text).alias("text")).mapInArrow(run, "document_id string, chunk_index int, content string, section string, page_number int")
    words = F.size(F.split(F.regexp_replace("content", r"^\s+|\s+$", ""), r"\s+"))
    return cut.select("document_id", "chunk_index", F.format_string("%s_c%04d", "document_id", "chunk_index").alias("chunk_id"), "content", "section", "page_number", F.length("content").alias("char_count"), words.alias("word_count"))


def ingestion_summary(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, characters, and whole characters per chunk."""
    return chunks.agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("char_count"), F.lit(0)).cast("long").alias("chars")).withColumn("avg_chars", F.expr("CASE WHEN chunks = 0 THEN 0 ELSE chars DIV chunks END"))
