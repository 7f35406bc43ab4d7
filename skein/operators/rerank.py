"""Second-stage ranking with an injected scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import tokens

CANDIDATES, TOP = 25, 8


def graph_context(edges: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(id, header): for each chunk its distinct facts, one per line in the order of their ids, under a heading."""
    line = F.concat("source_name", F.lit(" --["), "relationship_type", F.lit("]--> "), "target_name")
    once = edges.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"), line.alias("line")).agg(F.min("id").alias("first"))
    lines = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select("id", F.concat(F.lit("[GRAPH PATH]\n"), F.array_join("lines", "\n")).alias("header"))


def header(facts: str) -> Column:
    """Heading of a candidate's own facts, equal ones once, in their order; empty without any."""
    lines = F.array_distinct(F.coalesce(facts, F.array().cast("array<string>")))
    return F.when(F.size(lines) > 0, F.concat(F.lit("[GRAPH PATH]\n"), F.array_join(lines, "\n"))).otherwise("")


def candidate_text(content: Column, header: Column, graph_aware: bool) -> Column:
    """What the scorer reads: the content, led by the graph header if there is one and the mode asks for it."""
    if not graph_aware:
        return content
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n\n[DOCUMENT CONTENT]\n"), content)).otherwise(content)


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the query's distinct tokens that the text holds.  No model of relevance."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def model_score(model: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A scorer from any function over (query, text) pairs, run on Arrow batches."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(model(list(zip(query, text))), dtype="float64")

    return score


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score, top_k: int = TOP, mode: str = "baseline", telemetry: bool = False) -> DataFrame:
    """(query_id, id, reranker_score, rank, initial_rank) of (query_id, query, id, text, rank): scores are rounded before they are sorted, ties keep their order.

    In mode graph_aware the scorer reads the candidate's header, if there is a
    column of that name, before its text.  With telemetry come the mode, the
    lengths of what was read and of the text, and whether they differ.
    """
    text = F.coalesce("text", F.lit(""))
    own = candidate_text(text, F.col("header"), mode == "graph_aware") if "header" in candidates.columns else text
    more = [F.lit(mode).alias("reranking_mode"), F.length(own).alias("input_char_length"), F.length(text).alias("base_char_length"), (own != text).alias("graph_augmented")] if telemetry else []
    scored = candidates.select("query_id", "id", F.col("rank").alias("initial_rank"), F.round(scorer(F.col("query"), own), 6).alias("reranker_score"), *more)
    order = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "initial_rank", "id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top_k and top_k > 0:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "id", "reranker_score", "rank", "initial_rank", *scored.columns[4:])
