"""Context packing, citations and answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import strip

MAX_CHARS = 12_000
# Fixed value: what is answered without evidence.
NO_EVIDENCE = "The available documents do not provide sufficient information to answer this question."


def citation(n: Column, filename: Column, page: Column, section: Column) -> Column:
    """[n] file | Page p | Section: s; the section is left out when it is General, missing parts too."""
    sec = F.when(section.isNotNull() & (section != "General") & (section != ""), F.concat(F.lit("Section: "), section))
    return F.concat_ws(" | ", F.concat(F.lit("["), n.cast("string"), F.lit("] "), filename), F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))), sec)


def block(n: Column, filename: Column, page: Column, section: Column, chunk_id: Column, facts: Column, content: Column) -> Column:
    """One source of a context: its number, where it stands, at most three facts, and its text."""
    sec = F.when(section.isNotNull() & (section != "General"), F.concat(F.lit("Section: "), section))
    lines = F.transform(F.slice(F.coalesce(facts, F.array().cast("array<string>")), 1, 3), lambda x: F.concat(F.lit("[GRAPH RELATIONSHIP] "), x))
    return F.concat_ws("\n", F.concat(F.lit("[SOURCE "), n.cast("string"), F.lit("]")), F.concat(F.lit("Document: "), filename), F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))), sec, F.concat(F.lit("Chunk ID: "), chunk_id.cast("string")), lines, F.lit(""), F.lit("Content:"), content)


def pack(blocks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(query_id, rank, chunk_id, block, used_chars): the leading blocks that fit.

    Takes (query_id, rank, chunk_id, head, content), head being the block up
    to its text, which is stripped and ends the block with a line break.  Two characters part the blocks.  Packing stops at the first
    block that does not fit; the first one is always kept, cut to the limit
    but to no less than 50 characters of text, and marked with dots.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    full = F.concat("head", "content", F.lit("\n"))
    room = F.greatest(F.lit(50), F.lit(limit) - F.length("head") - 1)
    first = F.when(F.length(full) > limit, F.concat("head", F.substring(F.col("content"), F.lit(1), room), F.lit("...\n"))).otherwise(full)
    b = blocks.withColumn("content", strip(F.col("content"))).withColumn("block", F.when(F.col("rank") == 1, first).otherwise(full))
    b = b.withColumn("used_chars", (F.sum(F.length("block") + 2).over(order) - 2).cast("long"))
    return b.filter((F.col("rank") == 1) | (F.col("used_chars") <= limit)).select("query_id", "rank", "chunk_id", "block", "used_chars")


def contexts(packed: DataFrame) -> DataFrame:
    """(query_id, context): each query's blocks in rank order."""
    return packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def prompt(query: Column, context: Column) -> Column:
    """The fixed format of a prompt."""
    rule = "=" * 80
    text = F.when(F.length(F.trim(F.coalesce(context, F.lit("")))) > 0, F.trim(context)).otherwise("No relevant context found.")
    return F.concat(F.lit(f"RETRIEVED CONTEXT:\n{rule}\n"), text, F.lit(f"\n{rule}\n\nUSER QUESTION:\n"), F.trim(query), F.lit("\n\nANSWER (Grounded strictly in the retrieved context above, with [SOURCE X] citations):"))


def answer(asked: DataFrame, context: DataFrame, generate: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(query_id, query, answer, grounded): a fixed refusal without evidence, and no call to the model then.

    `generate` maps prompts to answers on Arrow batches.  Without one the
    stand-in quotes the first source's first sentence; it is no model.
    """
    both = asked.join(context, "query_id", "left")
    found = F.length(F.trim(F.coalesce(F.col("context"), F.lit("")))) > 0
    if generate is None:
        said = F.concat(F.regexp_extract(F.col("context"), r"(?s)Content:\n(.*?[.!?])(?:\s|$)", 1), F.lit(" [SOURCE 1]"))
    else:

        @F.pandas_udf("string")
        def call(p: pd.Series) -> pd.Series:
            return pd.Series(generate(list(p)))

        said = call(prompt(F.col("query"), F.col("context")))
    return both.select("query_id", "query", F.when(found, said).otherwise(NO_EVIDENCE).alias("answer"), found.alias("grounded"))


# Phrases of a refusal.
REFUSALS = ("i cannot find information", "does not contain information", "cannot answer", "insufficient evidence", "no evidence provided", "not mentioned in the provided", "no mention of")


def is_refusal(text: Column) -> Column:
    """Whether an answer has a phrase of a refusal, or is the message that stands for an answer without sources."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.contains(low, F.lit(NO_EVIDENCE.lower()))
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def source_tags(text: Column) -> Column:
    """Numbers of the [SOURCE n] tags, each once, in rising order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[SOURCE\s+(\d+)\]"), 1), lambda x: x.cast("int"))))


def provenance_badge(retrieved_by: Column) -> Column:
    v, g = F.array_contains(retrieved_by, "vector"), F.array_contains(retrieved_by, "graph")
    return F.when(v & g, "hybrid").when(g, "graph").when(v, "vector").otherwise("other")
