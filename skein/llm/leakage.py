"""Evaluation texts that stand in a corpus: pigeonhole pieces, then Myers' distance.

A passage that occurs with at most E edits holds, of E + 1 pieces that it is
split into, at least one unchanged.  So the pieces of every window of every
test item are looked up exactly, and a document's text around each hit is
compared with the item by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

#: Words in a row that make a leak.
RUN = 12
#: Edits (words inserted, dropped or replaced) that a window may have; the window is split into one piece more.
ERRORS = 1
#: Characters of test items that every worker holds at a time; more are taken in parts, with a pass over the documents for each.
MAX_ITEM_CHARS = 64_000_000

_WORDS = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(r"-(?<=[^\W\d_]-)[^\S\n]*\n[^\S\n]*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text, words cut by a hyphen at a line end joined again."""
    if not text:
        return []
    if "-" in text:
        text = _HYPHEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    return _WORDS.findall(text.lower())


def myers(pattern: list, text: list, limit: int) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any substring of text and where that ends; distance limit + 1 if it is over the limit.

    Myers' bit-parallel recurrence with Python integers as bit vectors, over
    any hashable symbols.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, min(m, limit + 1), 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """The test items, ready for look-up: words as numbers, and the hashes of all pieces of all windows."""

    vocabulary: dict[str, int]
    texts: list[tuple[str, np.ndarray]]  # item id, word numbers
    pieces: list[tuple[int, int]] = field(default_factory=list)  # per distinct piece length: (length, offset in the window)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)  # by piece length, sorted
    places: dict[int, list[np.ndarray]] = field(default_factory=dict)  # beside it: (text, position) of each


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every `length` numbers in a row."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def piece_lengths(run: int, errors: int) -> list[int]:
    """Lengths of the errors + 1 pieces of a window, as even as possible."""
    return [run // (errors + 1) + (i < run % (errors + 1)) for i in range(errors + 1)]


def prepare(rows: list[tuple[str, list[str]]], run: int = RUN, errors: int = ERRORS) -> Items:
    """rows: (item id, words) of each text of each item; texts of fewer than `run` words can't leak."""
    vocabulary: dict[str, int] = {}
    texts = []
    for item, ws in rows:
        if len(ws) >= run:
            texts.append((item, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.uint32)))
    out = Items(vocabulary, texts)
    for length in sorted(set(piece_lengths(run, errors))):
        hs, ts, ps = [], [], []
        for t, (_, ids) in enumerate(texts):
            h = _rolling(ids, length)
            hs.append(h), ts.append(np.full(len(h), t, np.int64)), ps.append(np.arange(len(h)))
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        o = np.argsort(h, kind="stable")
        out.hashes[length] = h[o]
        out.places[length] = [(np.concatenate(x) if x else np.empty(0, np.int64))[o] for x in (ts, ps)]
    return out


def _near(items: Items, docs: np.ndarray, which: np.ndarray, run: int, errors: int, done: set[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """(text, text position, position in docs) of piece hits whose windows are within the error budget, by Myers' distance.

    docs has the words of many documents, with zeros between them; which has
    the number of the document at each position.  Pairs of document and item
    in `done`, which the caller fills as it goes, are passed over.
    """
    near: dict[tuple[int, int, int], bool] = {}
    sizes = piece_lengths(run, errors)
    starts = [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]
    for length, table_ in items.hashes.items():
        h = _rolling(docs, length)
        if not len(h) or not len(table_):
            continue
        known = np.flatnonzero(docs[: len(h)])
        low = np.searchsorted(table_, h[known], "left")
        same = table_[np.minimum(low, len(table_) - 1)] == h[known]
        hit, low = known[same], low[same]
        high = np.searchsorted(table_, h[hit], "right")
        ts, ps = items.places[length]
        for at, doc, a, b in zip(hit.tolist(), which[hit].tolist(), low.tolist(), high.tolist()):
            for k in range(a, b):
                t, p = int(ts[k]), int(ps[k])
                item, ids = items.texts[t]
                if (doc, item) in done:
                    continue
                # the windows of which this is a piece, each against the text around the hit
                for offset, n in starts:
                    start = p - offset
                    if n != length or start < 0 or start + run > len(ids):
                        continue
                    key = (t, start, at - p)
                    if key not in near:
                        lo = max(0, at - offset - errors)
                        near[key] = myers(ids[start : start + run].tolist(), docs[lo : at - offset + run + errors].tolist(), errors)[0] <= errors
                    if near[key]:
                        yield t, p, at
                        break


def exact_run(a: np.ndarray, b: np.ndarray, i: int, j: int, run: int) -> bool:
    """Whether a and b have at least `run` equal numbers in a row around a[i], b[j]."""
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    k = 0
    while i - k > 0 and j - k > 0 and a[i - k - 1] == b[j - k - 1]:
        k += 1
    return n + k >= run


def match(texts: list[str | None], items: Items, run: int = RUN, errors: int = ERRORS, exact: bool = False) -> list[tuple[int, str]]:
    """(position in texts, item id) of the texts that hold a passage of an item."""
    get = items.vocabulary.get
    gap = np.zeros(run + errors + 1, np.uint32)
    parts, which = [gap], [np.full(len(gap), -1)]
    for i, text in enumerate(texts):
        ws = words(text)
        parts += [np.fromiter((get(w, 0) for w in ws), np.uint32, len(ws)), gap]
        which.append(np.full(len(ws) + len(gap), i))
    docs, which = np.concatenate(parts), np.concatenate(which)
    found: set[tuple[int, str]] = set()
    for t, p, at in _near(items, docs, which, run, errors, found):
        item, own = items.texts[t]
        if not exact or exact_run(own, docs, p, at, run):
            found.add((int(which[at]), item))
    return sorted(found)


def _worker(items, run: int, errors: int, exact: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(**items.value)
        for b in batches:
            keys = b.column(0).to_pylist()
            found = match(b.column(1).to_pylist(), own, run, errors, exact)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([keys[i] for i, _ in found], pa.int64()), "item_id": pa.array([x for _, x in found], pa.string())})

    return go


def leaks(docs: DataFrame, items: DataFrame, texts: list[str], run: int = RUN, errors: int = ERRORS, exact: bool = False) -> DataFrame:
    """(doc_id, item_id): documents that hold `run` words of an item in a row, with up to `errors` words edited; with exact, unedited.

    docs has doc_id and text, items has id and the columns named in texts.
    Null and blank texts and items never match; repeated documents each
    give their rows, an item filed under two ids is reported under both.
    Every document is read whole, without a shuffle, once for each part of
    the items (MAX_ITEM_CHARS).
    """
    spark = docs.sparkSession
    long = items.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), *texts)
    size = long.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in texts]).first()
    parts = sum(size) // MAX_ITEM_CHARS + 1
    src, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for i in range(parts):
        part = long if parts == 1 else long.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        rows = [(r[0], words(t)) for r in part.collect() for t in r[1:]]
        sent = spark.sparkContext.broadcast(vars(prepare(rows, run, errors)))  # as plain values, for workers without this package
        found = src.mapInArrow(_worker(sent, run, errors, exact), "doc_id long, item_id string")
        out = found if out is None else out.unionAll(found)
    return out


TEXTS = ["question", "expected_answer"]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) with at least 12 words in a row in common."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_questions"), TEXTS, exact=True)


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) with 12 words in a row in common, of which one may be edited."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_questions"), TEXTS)


QUERIES = {"p9_found": p9_found, "p9_edited": p9_edited}

_SPACE = r"[\t\x0b\x0c \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_JOIN = rf"'({_LETTER})-{_SPACE}\n{_SPACE}({_LETTER})', '\1\2', 'g'"


def _sql_runs(text: str) -> str:
    """SQL for all runs of 12 words of a text; twice, as neighbouring hyphens may share a letter."""
    lines = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    ws = f"regexp_extract_all(lower(regexp_replace(regexp_replace({lines}, {_JOIN}), {_JOIN})), '[\\p{{L}}\\p{{N}}]+')"
    return f"(SELECT list_transform(range(1, len(ws) - {RUN - 2}), lambda i: array_to_string(ws[i:i + {RUN - 1}], ' ')) FROM (SELECT {ws} AS ws))"


SQL = {
    "p9_found": f"""WITH g AS (SELECT doc_id, unnest({_sql_runs('text')}) AS r FROM documents WHERE text IS NOT NULL),
        i AS (SELECT DISTINCT id, unnest({_sql_runs('t')}) AS r FROM (SELECT id, unnest([question, expected_answer]) AS t FROM eval_questions) WHERE t IS NOT NULL)
        SELECT DISTINCT g.doc_id, i.id AS item_id FROM g JOIN i USING (r)""",
}
