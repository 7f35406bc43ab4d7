"""Okapi BM25 over a corpus table, for any number of queries in one plan."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.text import tokens
from skein.session import materialize

K1, B = 1.5, 0.75
#: About how many terms of queries, and cells of the table of terms by queries, every worker holds at a time.
MAX_QUERY_TERMS, MAX_CELLS = 200_000, 1 << 25


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, tf, dl): counted map-side; texts without tokens have no rows."""
    t = corpus.select(F.col(key).alias("id"), tokens(F.col(text)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(corpus: DataFrame, text: str) -> DataFrame:
    """One row (n, avgdl) over the whole corpus, rows that a caller may not see included."""
    return corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, qtf): a term that stands twice in a query counts twice."""
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _count(sent):
    """Per text its length in tokens, and the query terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        find, get = re.compile(r"\b[a-z0-9_-]+\b").findall, number.get
        for b in batches:
            lengths, terms, counts, offsets = [], [], [], [0]
            for t in b.column(1):
                words = find((t.as_py() or "").lower())
                lengths.append(len(words))
                own = Counter(i for i in map(get, words) if i is not None)
                terms += own.keys()
                counts += own.values()
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], names=["id", "dl", "terms", "tfs"])

    return run


def _score(sent, k: int, k1: float, b: float):
    """The k best texts of each query in each part of a batch: one matrix product of term weights and query counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked, avgdl = sent.value
        for whole in batches:
            step = max(16, min(1000, (1 << 23) // len(weight)))
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                n = part.num_rows
                size = np.diff(part.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(n), size)
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.float64)
                dl = part.column(1).to_numpy()[row]
                w = np.zeros((n, len(weight)))
                w[row, term] = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                s = (w @ asked).T
                ids = part.column(0)
                order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
                best = order[np.argsort(-np.round(s[:, order], 9), axis=1, kind="stable")[:, :k]]
                value = np.take_along_axis(s, best, 1)
                q, col = np.nonzero(value > 0)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), ids.take(pa.array(best[q, col])), pa.array(value[q, col])], names=["q", "id", "raw"])

    return run


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank): for each query its k best texts of positive score.

    Statistics are over the whole corpus; `allowed` (ids) narrows the
    candidates only.  Ties go to the smaller id.  Blank queries, unknown
    terms and k <= 0 give no rows.  The queries are a stated set, taken in
    parts of a bounded size (MAX_QUERY_TERMS, MAX_CELLS).  For each part every
    text is read once and leaves its counts of the queries' terms, and only
    each batch's k best texts per query are shuffled.
    """
    terms = query_terms(queries, query_key, query_text)
    n, t, q = terms.agg(F.count(F.lit(1)), F.count_distinct("term"), F.count_distinct("query_id")).first()
    parts = max(n // MAX_QUERY_TERMS, t * q // MAX_CELLS) + 1
    kind = queries.schema[query_key].dataType
    each = [terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, [_bm25_part(corpus, key, text, x.collect() if k > 0 else [], kind, k, allowed, k1, b) for x in each])


def _bm25_part(corpus: DataFrame, key: str, text: str, rows: list, query_kind, k: int, allowed: DataFrame | None, k1: float, b: float) -> DataFrame:
    spark = corpus.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
    names = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in rows))}
    kind = corpus.schema[key].dataType.simpleString()
    src = corpus if rows else corpus.limit(0)
    counted = materialize(src.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_count(spark.sparkContext.broadcast(number)), f"id {kind}, dl int, terms array<int>, tfs array<int>"))
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    df = np.zeros(max(1, len(number)))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r.t] = r.df
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = np.zeros((len(weight), max(1, len(names))))
    for r in rows:
        asked[number[r.term], names[r.query_id]] = r.qtf
    if allowed is not None:
        counted = counted.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
    sent = spark.sparkContext.broadcast((weight, asked, max(total / max(1, n), 1e-9)))
    found = counted.select("id", "dl", "terms", "tfs").mapInArrow(_score(sent, max(k, 1), k1, b), f"q int, id {kind}, raw double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("raw", 9).desc(), "id"))).filter(F.col("rank") <= k)
    back = spark.createDataFrame([(i, q) for q, i in names.items()], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", query_kind)]))
    return ranked.join(F.broadcast(back), "q").select("query_id", "id", F.round("raw", 4).alias("score"), "rank")
