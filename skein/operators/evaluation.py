"""Retrieval, graph, citation and answer metrics as expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of a refusal, as the metric counts them.
REFUSALS = ("not provide sufficient information", "insufficient information", "does not contain", "no evidence", "not mentioned", "unsupported")


def _ratio(hits: Column, gold: Column, found: Column) -> Column:
    """hits / |gold|; without gold 1 if nothing was found, else 0."""
    n = F.size(F.array_distinct(gold))
    return F.when(n == 0, F.when(F.size(found) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.nullif(n, F.lit(0)))


def recall_at(found: Column, gold: Column, k: int) -> Column:
    top = F.slice(found, 1, k)
    return _ratio(F.size(F.array_intersect(top, gold)), gold, found)


def hit_at(found: Column, gold: Column, k: int) -> Column:
    top = F.slice(found, 1, k)
    return F.when(F.size(gold) == 0, F.when(F.size(found) == 0, 1.0).otherwise(0.0)).otherwise(F.when(F.arrays_overlap(top, gold), 1.0).otherwise(0.0))


def mrr(found: Column, gold: Column) -> Column:
    """1 / position of the first gold item; 0 if there is none; without gold 1 if nothing was found."""
    at = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull()))
    return F.when(F.size(gold) == 0, F.when(F.size(found) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(1.0 / at, F.lit(0.0)))


def retrieval_metrics(found: Column, gold: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> list[Column]:
    out = [recall_at(found, gold, k).alias(f"recall_at_{k}") for k in ks] + [hit_at(found, gold, k).alias(f"hit_at_{k}") for k in ks]
    return [*out, mrr(found, gold).alias("mrr")]


def graph_metrics(vector: Column, graph: Column, gold: Column, seeds: Column, wanted: Column, edges: Column) -> list[Column]:
    """wanted and edges are arrays of "source|TYPE|target" keys; an edge counts in either direction."""
    turned = lambda a: F.transform(a, lambda x: F.concat_ws("|", F.element_at(F.split(x, r"\|"), 3), F.element_at(F.split(x, r"\|"), 2), F.element_at(F.split(x, r"\|"), 1)))
    both = F.array_union(edges, turned(edges))
    only = F.array_except(graph, vector)
    union = F.size(F.array_union(vector, graph))
    return [
        F.when(seeds > 0, 1.0).otherwise(0.0).alias("seed_hit"),
        F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.filter(wanted, lambda x: F.array_contains(both, x))) / F.nullif(F.size(wanted), F.lit(0))).alias("relationship_rate"),
        _ratio(F.size(F.array_intersect(graph, gold)), gold, graph).alias("provenance_coverage"),
        F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(vector, graph)) / F.nullif(union, F.lit(0))).alias("overlap_rate"),
        F.size(only).alias("unique_graph"), F.size(F.array_intersect(only, gold)).alias("unique_relevant"),
    ]


def citation_metrics(cited: Column, gold: Column) -> list[Column]:
    """Precision and recall of the cited ids; with nothing cited or wanted, 1 if both are empty, else 0."""
    hits = F.size(F.array_intersect(cited, gold))
    part = lambda n, other: F.when(n == 0, F.when(F.size(other) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.nullif(n, F.lit(0)))
    return [part(F.size(F.array_distinct(cited)), gold).alias("correctness"), part(F.size(F.array_distinct(gold)), cited).alias("completeness")]


def generation_metrics(answer: Column, entities: Column, context: Column, no_evidence: Column) -> list[Column]:
    """Entity coverage, groundedness and their blend; for a question without evidence, whether the answer refuses."""
    low, ctx = F.lower(F.trim(answer)), F.lower(context)
    refused = F.lit(False)
    for p in REFUSALS:
        refused = refused | F.contains(low, F.lit(p))
    refusal = F.when(refused, 1.0).otherwise(0.0)
    covered = F.when(F.size(entities) == 0, 1.0).otherwise(F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))) / F.nullif(F.size(entities), F.lit(0)))
    said = F.filter(F.transform(F.split(low, r"[.!?\n]"), F.trim), lambda s: F.length(s) > 15)
    words = lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) > 3)
    held = F.filter(said, lambda s: (F.size(words(s)) > 0) & (F.size(F.filter(words(s), lambda w: F.contains(ctx, w))) >= 0.65 * F.size(words(s))))
    grounded = F.when(F.size(said) == 0, 1.0).otherwise(F.size(held) / F.nullif(F.size(said), F.lit(0)))
    pick = lambda value: F.when(no_evidence, refusal).otherwise(value)
    return [pick(covered).alias("entity_coverage"), pick(F.lit(1.0)).alias("refusal_correctness"), pick(grounded).alias("groundedness"), pick(covered * 0.7 + grounded * 0.3).alias("answer_correctness")]


def verdict(h3: Column, v3: Column, h5: Column, v5: Column, hm: Column, vm: Column, unique: Column) -> Column:
    return F.when((h3 > v3) | (h5 > v5) | (hm > vm) | (unique > 0), "hybrid_won").when((v3 > h3) | (v5 > h5) | (vm > hm), "vector_won").otherwise("tie")


def summary(per_question: DataFrame, group: str, metrics: list[str], verdict: str | None = None, verdicts: tuple[str, ...] = ()) -> DataFrame:
    """Means per group and over all (group null), rounded to four places, and how often each verdict fell, from one rollup."""
    return per_question.rollup(group).agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], *[F.count_if(F.col(verdict) == v).alias(v) for v in verdicts])


def macro_average(per_question: DataFrame, suite: str, metrics: list[str]) -> DataFrame:
    """Unweighted mean of the suites' means."""
    means = per_question.groupBy(suite).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
