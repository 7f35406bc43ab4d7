"""Exact cosine search over stored vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DIM = 384
#: About how many query vectors every worker holds at a time.
MAX_QUERIES = 16_384


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, allowed: DataFrame | None = None, dim: int = DIM) -> DataFrame:
    """(query_id, id, distance, similarity, rank): for each query vector its k nearest, by exact scan.

    The queries are a stated set, sent to the scan in parts of about
    MAX_QUERIES; each few rows are one matrix product, and only the k best
    rows of a batch per query go on.  Ties go to the smaller id; null, zero and
    wrong-sized vectors take no part; k <= 0 gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    base = vectors.filter(v.isNotNull() & (F.size(v) == dim)).select(F.col(key).alias("id"), v.alias("v"), *([F.col(allowed.columns[0])] if allowed is not None and allowed.columns[0] != key else []))
    if allowed is not None:
        on = "id" if allowed.columns[0] == key else allowed.columns[0]
        base = base.join(allowed.select(F.col(allowed.columns[0]).alias(on)), on, "left_semi")
    asked = queries.filter(F.col(query_vector).isNotNull() & (F.size(query_vector) == dim)).select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("v"))
    parts = asked.count() // MAX_QUERIES + 1
    each = [asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, [_nearest(spark, base, [r for r in x.collect() if any(r.v)], asked.schema["query_id"].dataType, k, dim) for x in each])


def _nearest(spark: SparkSession, base: DataFrame, rows: list, query_kind: T.DataType, k: int, dim: int) -> DataFrame:
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("query_id", query_kind)]))
    sent = spark.sparkContext.broadcast(np.array([r.v for r in rows], np.float64).reshape(len(rows), dim))

    def run(batches):
        q = sent.value
        q = q / np.linalg.norm(q, axis=1)[:, None] if len(q) else q
        step = max(256, (1 << 24) // max(1, len(q)))  # rows whose distances are held at a time
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            good = np.flatnonzero(n > 0)
            if not len(good) or not len(q) or k <= 0:
                continue
            d = 1 - q @ (x[good] / n[good, None]).T
            ids = b.column(0).take(pa.array(good))
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            best = order[np.argsort(np.round(d[:, order], 9), axis=1, kind="stable")[:, :k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), best.shape[1])), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(d, best, axis=1).ravel())], names=["_q", "id", "d"])

    kind = base.schema["id"].dataType.simpleString()
    near = base.select("id", "v").mapInArrow(run, f"_q int, id {kind}, d double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.round("d", 9), "id"))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "_q").select("query_id", "id", F.round("d", 4).alias("distance"), F.round(F.greatest(F.lit(0.0), 1 - F.col("d")), 4).alias("similarity"), "rank")


def semantic_argmax(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, threshold: float = 0.65, dim: int = DIM) -> DataFrame:
    """(query_id, id, similarity): the most similar row of each query if it reaches the threshold."""
    best = cosine_topk(vectors, key, vector, queries, query_key, query_vector, 1, None, dim)
    return best.filter(F.col("similarity") >= threshold).select("query_id", "id", "similarity")


def vector_consistency(vectors: DataFrame, vector: str, dim: int = DIM, same: Sequence[str] = ()) -> DataFrame:
    """One row: how many vectors there are, null, of another length, all zero, not of unit length, and whether all that are not null have the dimension and, where such columns are named, one provider, model and the like."""
    v = F.col(vector)
    n = norm(v)
    kinds = F.count_distinct(F.when(v.isNotNull(), F.to_json(F.struct(*same)))) if same else F.lit(1)
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.size(v) != dim).alias("other_length"), F.count_if(n == 0).alias("zeros"), F.count_if(F.abs(n - 1) > 0.001).alias("not_unit"), kinds.alias("_kinds"),
    ).withColumn("consistent", (F.col("other_length") == 0) & (F.col("_kinds") <= 1)).drop("_kinds")
