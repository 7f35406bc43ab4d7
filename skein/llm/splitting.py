"""Splitting oversized texts at natural boundaries.

Dynamic programming over boundary positions: the cuts of a text are those of
least total cost, where a cut costs more the less natural its boundary is,
and a piece costs more the further its length is from an even share.  No
piece exceeds the limit; of every piece but the first, room for the overlap is
kept free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ranking import running_total
from skein.session import materialize
from skein.sources.tables import table

SIZE = 800
OVERLAP = 150
LEVELS = ("paragraph", "line", "sentence", "word", "none")
#: What a cut costs, by level; a hard cut costs more than any number of natural ones in reach.
PENALTY = (0.0, 1.0, 3.0, 20.0, 400.0)

# In each pattern the boundary is the matched white space.
_PARAGRAPH = re.compile(r"\n(?:[^\S\n]*\n)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\s+")
_PATTERNS = (_PARAGRAPH, _LINE, _SENTENCE, _WORD)


def clean(text: str) -> str:
    """CR LF as one line break, no white space at the ends."""
    return text.replace("\r\n", "\n").strip()


def _bounds(text: str, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all boundaries up to a level, in order: where the text before ends, where the next part starts, and the level."""
    best: dict[int, tuple[int, int]] = {}
    for n in range(min(level, 3) + 1):
        for m in _PATTERNS[n].finditer(text):
            a, b = m.span()
            while a > 0 and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            best.setdefault(a, (b, n))
    ends = np.array(sorted(best), dtype=np.int64)
    starts = np.array([best[a][0] for a in ends], dtype=np.int64)
    kinds = np.array([best[a][1] for a in ends], dtype=np.int64)
    return ends, starts, kinds


def _hard(ends: np.ndarray, starts: np.ndarray, kinds: np.ndarray, n: int, size: int) -> tuple[np.ndarray, ...]:
    """Add hard cuts, evenly inside each part that is over the size."""
    e, s, k = [ends], [starts], [kinds]
    for a, b in zip(np.concatenate([[0], starts]), np.concatenate([ends, [n]])):
        if b - a > size:
            pieces = -(-(b - a) // size)
            at = a + (np.arange(1, pieces) * (b - a)) // pieces
            e.append(at), s.append(at), k.append(np.full(len(at), 4))
    e, s, k = np.concatenate(e), np.concatenate(s), np.concatenate(k)
    o = np.argsort(e, kind="stable")
    return e[o], s[o], k[o]


def _programme(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, size: int, reserve: int) -> list[tuple[int, int]] | None:
    """The cheapest pieces (start, end) from 0 to n between the given boundaries, the first of at most `size`, the others of at most size - reserve; None if no pieces reach the end."""
    ends, starts, kinds = bounds
    at = np.concatenate([[0], starts])  # where a piece may start
    stop = np.concatenate([ends, [n]])  # where it may end
    cut = np.array([*(PENALTY[k] for k in kinds), 0.0])
    share = n / -(-n // max(1, size - reserve))
    m = len(stop)
    cost, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
    cost[0] = 0.0
    low = 0  # the first start in reach
    for i in range(m):
        while low <= i and stop[i] - at[low] > (size - reserve if low else size):
            low += 1
        c = cost[low : i + 1] + cut[i] + ((stop[i] - at[low : i + 1] - share) / share) ** 2 * 4
        if not len(c) or not np.isfinite(c.min()):
            return None  # later ends are out of reach, too
        j = int(np.argmin(c))
        cost[i + 1], back[i + 1] = c[j], low + j
    pieces, i = [], m
    while i > 0:
        pieces.append((int(at[back[i]]), int(stop[i - 1])))
        i = int(back[i])
    return pieces[::-1]


def cut_level(text: str, size: int = SIZE) -> int:
    """Number of the first level at whose boundaries the programme reaches the end of a cleaned text; the last one if only hard cuts do."""
    for level in range(4):
        if _programme(_bounds(text, level), len(text), size, 0) is not None:
            return level
    return 4


def plan(text: str, size: int = SIZE, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int]]]:
    """(level, pieces) of a cleaned text: level names the coarsest boundaries with which all parts fit, pieces are (start, end) without overlap.

    The pieces leave room for the overlap, so they may need finer boundaries
    than the level's.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    n = len(text)
    if n <= size:
        return LEVELS[0], [(0, n)]
    first = cut_level(text, size)
    for level in range(first, 4):
        pieces = _programme(_bounds(text, level), n, size, overlap)
        if pieces is not None:
            return LEVELS[first], pieces
    return LEVELS[first], _programme(_hard(*_bounds(text, 4), n, size - overlap), n, size, overlap)


def with_overlap(text: str, pieces: list[tuple[int, int]], overlap: int = OVERLAP) -> list[str]:
    """The pieces' texts, each led by the `overlap` characters that stand before it, from the next word's start on; a word longer than the overlap is repeated in part."""
    out = []
    for start, end in pieces:
        low = max(0, start - overlap)
        if 0 < low < start and not text[low - 1].isspace():
            m = _WORD.search(text, low, start)
            if m and m.end() < start:
                low = m.end()
        while low < start and text[low].isspace():
            low += 1
        out.append(text[low:end])
    return out


def _levels(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cuts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = clean(t.as_py())
                if len(t) > size:
                    ids.append(i)
                    cuts.append(LEVELS[cut_level(t, size)])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "cut_at": pa.array(cuts, pa.string())})

    return run


def _pieces(size: int, overlap: int):
    """Each row as often as its last column, the content, has pieces, with the piece's number and text instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers, texts = [], [], []
            for i, t in enumerate(b.columns[-1]):
                t = out = t.as_py()
                if t is not None and len(t) > size and len(t := clean(t)) > size:
                    out = with_overlap(t, plan(t, size, overlap)[1], overlap)
                out = out if isinstance(out, list) else [out]
                rows += [i] * len(out)
                numbers += range(len(out))
                texts += out
            kept = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "piece", "content"])

    return run


def split_levels(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, cut_at) of every chunk whose stripped content is over the size.

    Null, empty and short contents give no row; repeated rows give repeated
    rows.  CR LF counts as one character.  The length is tested in the JVM
    first, so only oversized texts reach Python.
    """
    long = chunks.filter(F.length("content") > size).select(F.col("id").cast("long").alias("id"), "content")
    return long.mapInArrow(_levels(size), "id long, cut_at string")


def split_chunks(chunks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, document_id, page_number, piece, chunk_index, content): all chunks, those over the size in pieces.

    Other chunks pass unchanged as piece 0, null and blank ones too.
    chunk_index counts anew from 0 in each document, in the order of the old
    chunk_index (nulls first), then id.  Chunks with a null document_id are
    numbered as one document.  Rows are told apart by a number of their own,
    so null and repeated ids keep their rows.
    """
    src = chunks.select(F.monotonically_increasing_id().alias("_row"), F.col("id").cast("long").alias("id"), F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.col("chunk_index").cast("int").alias("_old"), "content")
    kind = "_row long, id long, document_id long, page_number int, _old int, piece int, content string"
    cut = materialize(src.mapInArrow(_pieces(size, overlap), kind))
    order = [F.col("_old").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("_row").asc(), F.col("piece").asc()]
    base = cut.select("_row", "id", "document_id", "_old", "piece", F.lit(1).cast("long").alias("_one"))
    placed = running_total(base, ["document_id"], order, "_one", "chunk_index").select("_row", "piece", F.col("chunk_index").cast("int").alias("chunk_index"))
    return cut.join(placed, ["_row", "piece"]).select("id", "document_id", "page_number", "piece", "chunk_index", "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, cut_at) of the chunks of over 800 characters."""
    return split_levels(table(spark, d, "chunks"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, those of over 800 characters in pieces with overlap."""
    return split_chunks(table(spark, d, "chunks"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LS = r"[\t\r\x0b\x0c \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"'^{_WS}+|{_WS}+$', '', 'g'"


def _fits(marked: str) -> str:
    return f"list_max(list_transform(string_split({marked}, chr(1)), lambda x: length(regexp_replace(x, {_STRIP})))) <= {SIZE}"


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

SQL = {
    "p1_found": f"""
        WITH t AS (SELECT id, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), {_STRIP}) AS s FROM chunks)
        SELECT id, CASE
            WHEN {_fits(f"regexp_replace(s, '{chr(92)}n({_LS}*{chr(92)}n)+', chr(1), 'g')")} THEN 'paragraph'
            WHEN {_fits("replace(s, chr(10), chr(1))")} THEN 'line'
            WHEN {_fits(f"regexp_replace(replace(s, chr(10), chr(1)), '([.!?]){_WS}+', '{chr(92)}1' || chr(1), 'g')")} THEN 'sentence'
            WHEN {_fits(f"regexp_replace(s, '{_WS}+', chr(1), 'g')")} THEN 'word'
            ELSE 'none' END AS cut_at
        FROM t WHERE length(s) > {SIZE}""",
}
