"""Seeds, bounded traversal, provenance and statistics of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import STOP_WORDS
from skein.operators.gold import contained, terms_of
from skein.session import materialize

MAX_CANDIDATES, MAX_LIKE = 100, 30


def keywords(c: Column) -> Column:
    """Phrases of a query that may name an entity: quoted parts, capitalised runs, and runs of one to four words that are not all stop words; longest first, then by number of words, then by text."""
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    c = F.coalesce(c, F.lit(""))
    trim = lambda x: F.regexp_replace(x, r"^[ .\-,]+|[ .\-,]+$", "")
    quoted = F.transform(F.regexp_extract_all(c, F.lit(r"""["']([^"']+)["']"""), 1), F.trim)
    capital = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Z0-9][a-zA-Z0-9_\-./]*(?:\s+[A-Z0-9][a-zA-Z0-9_\-./]*)*)"), 1), trim)
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-./]", " "), r"\s+"), lambda w: w != "")
    runs = []

    def slices(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.slice(words, i, n))

    for n in range(1, 5):
        grams = F.when(F.size(words) >= n, slices(n)).otherwise(F.array().cast("array<array<string>>"))
        kept = F.filter(grams, lambda g: F.exists(g, lambda w: ~F.array_contains(stop, F.lower(w))))
        runs.append(F.transform(kept, lambda g: trim(F.array_join(g, " "))))
    every = F.array_distinct(F.concat(quoted, capital, *runs))
    good = F.filter(every, lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, F.lower(x)))
    ranked = F.array_sort(F.transform(good, lambda x: F.struct((-F.length(x)).alias("a"), (-F.size(F.split(x, " "))).alias("b"), x.alias("x"))))
    return F.transform(ranked, lambda s: s["x"])


def seed_exact(candidates: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """(query_id, entity_id, rank): entities whose canonical or display name is a candidate, letter case aside; longer names first, then by id."""
    c = candidates.select("query_id", F.lower("candidate").alias("name")).distinct()
    names = entities.select(F.col("id").alias("entity_id"), F.length("canonical_name").alias("len"), F.explode(F.array_distinct(F.array(F.lower("canonical_name"), F.lower("display_name")))).alias("name"))
    hit = c.join(names, "name").select("query_id", "entity_id", "len").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("len"), "entity_id")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "entity_id", "rank")


def seed_like(candidates: DataFrame, entities: DataFrame, exact: DataFrame, limit: int) -> DataFrame:
    """(query_id, entity_id, rank): where exact matches leave room, entities whose name contains a candidate, as ILIKE does (_ and % in a candidate match anything).

    The candidates are a stated set; all names are scanned once for them.
    """
    left = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    c = candidates.join(left, "query_id", "left").filter(F.coalesce("have", F.lit(0)) < limit).select("query_id", "candidate", (F.lit(limit) - F.coalesce("have", F.lit(0))).alias("room"))
    names = entities.select(F.col("id").alias("entity_id"), F.explode(F.array("canonical_name", "display_name")).alias("name"))
    found = contained(names, "entity_id", "name", c.select("query_id", F.col("candidate").alias("name")), like=True)
    hit = found.withColumnRenamed("chunk_id", "entity_id").join(exact.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
    hit = hit.join(c.select("query_id", "room").distinct(), "query_id").join(entities.select(F.col("id").alias("entity_id"), F.length("canonical_name").alias("len")), "entity_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("len"), "entity_id")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("room")).select("query_id", "entity_id", "rank")


def find_seeds(candidates: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """(query_id, entity_id) of candidates (query_id, pos, candidate), pos being their order: exact names of the first MAX_CANDIDATES, then, where there is room, names that contain one of the first MAX_LIKE short ones (3 to 35 characters, up to three words)."""
    order = Window.partitionBy("query_id").orderBy("pos", "candidate")
    first = candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_CANDIDATES).drop("_n")
    exact = materialize(seed_exact(first, entities, limit))
    short = F.length("candidate").between(3, 35) & (F.size(F.filter(F.split("candidate", r"\s+"), lambda w: w != "")) <= 3)
    few = candidates.filter(short).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_LIKE)
    return exact.unionByName(seed_like(few.select("query_id", "candidate"), entities, exact, limit)).select("query_id", "entity_id")


def named_edges(edges: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges of documents that the caller may see, with their ends' names."""
    name = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_name"))
    seen = edges.join(allowed.select(F.col(allowed.columns[0]).alias("document_id")), "document_id", "left_semi")
    return seen.join(name("source"), "source_entity_id").join(name("target"), "target_entity_id").select("id", "source_entity_id", "source_name", "relationship_type", "target_entity_id", "target_name", "document_id", "chunk_id", "page_number")


def with_names(found: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Edges with the canonical names of their ends; edges of unknown entities are dropped.  Without entities the edges have names already."""
    if entities is None:
        return found
    name = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_name"))
    return found.join(name("source"), "source_entity_id").join(name("target"), "target_entity_id")


def first_edges(edges: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """(entity_id, edge): of each entity among `ends` (entity_id) its first `limit` edges by id.

    The cut happens before the shuffle, too, so an entity that holds a third
    of all edges sends no more than `limit` from any task.
    """
    both = edges.select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"), *edges.columns)
    near = both.join(ends.select("entity_id").distinct(), "entity_id", "left_semi")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy("id"))).filter(F.col("_n") <= limit).drop("_n")


def incident(edges: DataFrame, seeds: DataFrame, limit: int, exclude: DataFrame | None = None, excluded: int = 0) -> DataFrame:
    """Per query the first `limit` edges, by id, with an end among its seeds (query_id, entity_id), without those of `exclude`, which has at most `excluded` a query.

    A query's first edges are among the first ones of its seeds, so no seed's
    edges are joined beyond those.
    """
    hit = first_edges(edges, seeds, limit + excluded).join(seeds.select("query_id", "entity_id"), "entity_id").select("query_id", *edges.columns).dropDuplicates(["query_id", "id"])
    if exclude is not None:
        hit = hit.join(exclude.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("_n") <= limit).drop("_n")


def _fact() -> Column:
    return F.concat("source_name", F.lit(" --["), "relationship_type", F.lit("]--> "), "target_name")


def hop1(edges: DataFrame, seeds: DataFrame, max_results: int, entities: DataFrame | None = None) -> DataFrame:
    """The seeds' edges with their path and, per edge, the end that is not a seed (null if both are).  Names come with the edges, or for the edges found from `entities`."""
    got = with_names(incident(edges, seeds, max_results), entities)
    s = seeds.select("query_id", F.col("entity_id").alias("target_entity_id"), F.lit(True).alias("_t"))
    o = seeds.select("query_id", F.col("entity_id").alias("source_entity_id"), F.lit(True).alias("_s"))
    got = got.join(o, ["query_id", "source_entity_id"], "left").join(s, ["query_id", "target_entity_id"], "left")
    near = F.when(F.col("_s").isNull(), F.col("source_entity_id")).when(F.col("_t").isNull(), F.col("target_entity_id"))
    return got.select("query_id", "id", "source_entity_id", "source_name", "relationship_type", "target_entity_id", "target_name", "document_id", "chunk_id", "page_number", _fact().alias("path"), near.alias("neighbour"))


def hop2(edges: DataFrame, seeds: DataFrame, first: DataFrame, max_results: int, per_anchor: int = 5, entities: DataFrame | None = None) -> DataFrame:
    """Edges one step beyond the neighbours of `first`, within the budget that hop 1 left; lead is the fact that leads to the anchor.

    A batch of edges by id is cut first, then edges back to a seed or to the
    anchor's own parent are dropped, then each anchor keeps its first
    per_anchor edges and the query its first `budget`.
    """
    used = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
    parents = first.filter(F.col("neighbour").isNotNull()).groupBy("query_id", "neighbour").agg(F.min_by(F.struct(F.col("path").alias("parent_path"), F.when(F.col("neighbour") == F.col("source_entity_id"), F.col("target_entity_id")).otherwise(F.col("source_entity_id")).alias("parent")), "id").alias("p"))
    near = parents.select("query_id", F.col("neighbour").alias("entity_id"), "p.parent_path", "p.parent")
    got = incident(edges, near.select("query_id", "entity_id"), 100, first, max_results).join(used, "query_id")
    got = got.withColumn("budget", F.lit(max_results) - F.col("used")).filter("budget > 0")
    batch = F.least(F.greatest(2 * F.col("budget"), F.lit(50)), F.lit(100))
    got = got.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("_n") <= batch)
    got = with_names(got, entities)
    a = near.select("query_id", F.col("entity_id").alias("source_entity_id"), F.struct("parent_path", "parent").alias("_sa"))
    b = near.select("query_id", F.col("entity_id").alias("target_entity_id"), F.struct("parent_path", "parent").alias("_ta"))
    got = got.join(a, ["query_id", "source_entity_id"], "left").join(b, ["query_id", "target_entity_id"], "left")
    at_source = F.col("_sa").isNotNull()
    got = got.select("*", F.when(at_source, F.col("source_entity_id")).otherwise(F.col("target_entity_id")).alias("anchor"), F.when(at_source, F.col("target_entity_id")).otherwise(F.col("source_entity_id")).alias("other"), F.coalesce("_sa", "_ta").alias("_p"))
    got = got.filter(F.col("other") != F.col("_p.parent")).join(seeds.select("query_id", F.col("entity_id").alias("other")), ["query_id", "other"], "left_anti")
    got = got.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "anchor").orderBy("id"))).filter(F.col("_n") <= per_anchor)
    got = got.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("_n") <= F.col("budget"))
    far = F.when(F.col("anchor") == F.col("source_entity_id"), F.col("target_name")).otherwise(F.col("source_name"))
    path = F.concat("_p.parent_path", F.lit(" -> "), "relationship_type", F.lit(" -> "), far)
    return got.select("query_id", "id", "source_entity_id", "source_name", "relationship_type", "target_entity_id", "target_name", "document_id", "chunk_id", "page_number", path.alias("path"), "anchor", _fact().alias("fact"), F.col("_p.parent_path").alias("lead"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_results: int = 50, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, hop, id, path, fact, lead, ...) of one or two hops; another depth, or no room for a result, raises.

    fact is the edge itself; of a second hop, lead is the edge before it.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    if max_results <= 0:
        raise ValueError("max_results must be positive")
    first = hop1(edges, seeds, max_results, entities)
    cols = ["query_id", "id", "source_entity_id", "source_name", "relationship_type", "target_entity_id", "target_name", "document_id", "chunk_id", "page_number", "path"]
    if depth == 2:
        first = materialize(first)
    out = first.select(*cols, F.col("path").alias("fact"), F.lit(None).cast("string").alias("lead"), F.lit(1).alias("hop"))
    if depth == 2:
        out = out.unionByName(hop2(edges, seeds, first, max_results, entities=entities).select(*cols, "fact", "lead", F.lit(2).alias("hop")))
    return out


def retrieval_status(queries: DataFrame, seeds: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, status, seed_count, relationship_count, connected_entity_count, source_chunk_count, document_count) of every query (query_id, text): empty_query, no_seed_entities_found or success."""
    n = seeds.groupBy("query_id").agg(F.count_distinct("entity_id").alias("seed_count"))
    r = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("relationship_count"), F.count_distinct("chunk_id").alias("source_chunk_count"), F.count_distinct("document_id").alias("document_count"))
    c = connected(found, seeds).groupBy("query_id").agg(F.count(F.lit(1)).alias("connected_entity_count"))
    counts = ("seed_count", "relationship_count", "connected_entity_count", "source_chunk_count", "document_count")
    j = queries.select("query_id", (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("_blank")).join(n, "query_id", "left").join(r, "query_id", "left").join(c, "query_id", "left")
    status = F.when(F.col("_blank"), "empty_query").when(F.col("seed_count").isNull(), "no_seed_entities_found").otherwise("success")
    return j.select("query_id", status.alias("status"), *[F.when(F.col("_blank"), 0).otherwise(F.coalesce(x, F.lit(0))).cast("long").alias(x) for x in counts])


def connected(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, entity_id): ends of found edges that are no seeds."""
    ends = found.select("query_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    return ends.join(seeds.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")


def provenance(found: DataFrame) -> DataFrame:
    """(query_id, chunks, documents, pages): sorted distinct ids that found edges come from."""
    ids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return found.groupBy("query_id").agg(ids("chunk_id").alias("chunks"), ids("document_id").alias("documents"), ids("page_number").alias("pages"))


def link_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, canonical, method, score) of (query_id, text) against (term, canonical).

    Codes (words with hyphens between letters or digits) match as a whole
    first; other terms match at word boundaries, terms with other characters
    or digits anywhere.  One hit per canonical name: codes, then exact names,
    then other aliases, longer terms first.
    """
    q = queries.select("query_id", F.lower("text").alias("text"))
    codes = q.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)+)"), 1))).alias("term"))
    by_code = codes.join(aliases, "term").select("query_id", "canonical", F.lit("code_alias").alias("method"), F.lit(1.0).alias("score"), F.length("term").alias("len"), F.lit(0).alias("prio"))
    hit = terms_of(queries, aliases.select("term", "canonical")).filter(F.col("whole") | F.col("term").rlike("[^a-z ]"))
    exact = F.col("term") == F.col("canonical")
    by_term = hit.select("query_id", "canonical", F.when(exact, "exact").otherwise("alias").alias("method"), F.when(exact, 1.0).otherwise(0.98).alias("score"), F.length("term").alias("len"), F.when(exact, 1).otherwise(2).alias("prio"))
    order = Window.partitionBy("query_id", "canonical").orderBy("prio", F.desc("len"))
    return by_code.unionByName(by_term).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("query_id", "canonical", "method", "score")


def prune_unseen(linked: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Linked entities (entity_id) with at least one edge in a document that the caller may see."""
    seen = edges.join(allowed.select(F.col(allowed.columns[0]).alias("document_id")), "document_id", "left_semi")
    ends = seen.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    return linked.join(ends, "entity_id", "left_semi")


def entity_edges(edges: DataFrame, entities: DataFrame, entity_id: int, direction: str = "both") -> DataFrame:
    """(id, direction, source_name, relationship_type, target_name) of one entity's outgoing, incoming or all edges."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction must be outgoing, incoming or both")
    out, inc = F.col("source_entity_id") == entity_id, F.col("target_entity_id") == entity_id
    cond = {"outgoing": out, "incoming": inc, "both": out | inc}[direction]
    name = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_name"))
    got = edges.filter(cond).join(name("source"), "source_entity_id").join(name("target"), "target_entity_id")
    return got.select("id", F.when(out, "outgoing").otherwise("incoming").alias("direction"), "source_name", "relationship_type", "target_name")


def subgraph(edges: DataFrame, entities: DataFrame, pattern: str, entity_type: str | None, max_nodes: int, max_edges: int = 100) -> DataFrame:
    """(id, source_entity_id, relationship_type, target_entity_id): edges of the first max_nodes entities whose name contains the pattern, equal facts once, by id."""
    chosen = entities.filter(F.contains(F.lower("canonical_name"), F.lit(pattern.lower())))
    if entity_type:
        chosen = chosen.filter(F.col("entity_type") == entity_type)
    chosen = chosen.orderBy("id").limit(max_nodes).select(F.lit(0).alias("query_id"), F.col("id").alias("entity_id"))
    got = incident(edges.select("id", "source_entity_id", "relationship_type", "target_entity_id"), chosen, max_edges)
    return got.groupBy("source_entity_id", "relationship_type", "target_entity_id").agg(F.min("id").alias("id")).select("id", "source_entity_id", "relationship_type", "target_entity_id")


def evidence_nodes(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, entity_id, first_edge, is_seed): nodes of the returned edges with the edge that each appears in first."""
    ends = found.select("query_id", "id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).groupBy("query_id", "entity_id").agg(F.min("id").alias("first_edge"))
    flag = seeds.select("query_id", "entity_id", F.lit(True).alias("is_seed"))
    return ends.join(flag, ["query_id", "entity_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))


def type_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def degree_top(per_side: DataFrame, entities: DataFrame, k: int = 20) -> DataFrame:
    """(entity_id, canonical_name, degree) of the k entities with most edges, from per-side counts; ties by id."""
    d = per_side.groupBy("entity_id").agg(F.sum("n_edges").alias("degree"))
    named = d.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return named.orderBy(F.desc("degree"), "entity_id").limit(k).select("entity_id", "canonical_name", "degree")


def document_inventory(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, filename, n_chunks, n_relationships): each side is counted before it is joined, so chunks and edges never multiply."""
    c = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    r = edges.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_relationships"))
    zero = F.lit(0).cast("long")
    return documents.select("doc_id", "filename").join(c, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", "filename", F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("n_relationships", zero).alias("n_relationships"))
