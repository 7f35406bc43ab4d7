"""Queries of the knowledge graph: seeds, traversal, linking, statistics, and its building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import ontology, text
from skein.operators import graph_build, graph_query, skew, store
from skein.plans.common import ACL, allowed_documents, questions
from skein.session import materialize
from skein.sources.tables import table

QUERIES, SQL = {}, {}
SEEDS = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _entity_candidates(spark, d):
    """(query_id, candidate): for each question the name of an entity of its document, and the name's last word."""
    e = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.trim("canonical_name").alias("name"))
    named = _seeds(spark, d).join(e, "entity_id")
    return named.select("query_id", F.explode(F.array("name", F.element_at(F.split("name", " "), -1))).alias("candidate"))


def _edges(spark, d):
    """Edges of documents that the caller may see, without names."""
    return table(spark, d, "relationships").select("id", "source_entity_id", "relationship_type", "target_entity_id", "document_id", "chunk_id", "page_number").join(allowed_documents(spark, d), "document_id", "left_semi")


# Seeds: the source of the first relationship of each question's document, which always exists.
_SEED = "seeds AS (SELECT DISTINCT e.id AS query_id, r.source_entity_id AS entity_id FROM eval_questions e JOIN (SELECT document_id, arg_min(source_entity_id, id) AS source_entity_id FROM relationships GROUP BY document_id) r ON r.document_id = e.expected_pages[1].document_id)"
_CAND = f"{_SEED}, cand AS (SELECT query_id, unnest([trim(canonical_name), string_split(trim(canonical_name), ' ')[-1]]) AS candidate FROM seeds JOIN entities e ON e.id = seeds.entity_id)"
_EXACT = f"""{_CAND}, en AS (SELECT id AS entity_id, length(canonical_name) AS len, unnest([lower(canonical_name), lower(display_name)]) AS name FROM entities),
    ex AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, entity_id) AS rank FROM (SELECT DISTINCT query_id, entity_id, len FROM cand JOIN en ON en.name = lower(cand.candidate)) QUALIFY rank <= {SEEDS})"""


def _exact(spark, d):
    return graph_query.seed_exact(_entity_candidates(spark, d), table(spark, d, "entities"), SEEDS)


@query(f"WITH {_EXACT} SELECT * FROM ex")
def seed_exact(spark, d):
    return _exact(spark, d)


@query(f"""WITH {_EXACT}, have AS (SELECT query_id, count(*) AS have FROM ex GROUP BY query_id),
    open AS (SELECT query_id, candidate, {SEEDS} - coalesce(have, 0) AS room FROM cand LEFT JOIN have USING (query_id) WHERE coalesce(have, 0) < {SEEDS})
    SELECT query_id, entity_id, rank FROM (SELECT query_id, entity_id, room, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, entity_id) AS rank FROM (
        SELECT DISTINCT o.query_id, e.id AS entity_id, length(e.canonical_name) AS len, o.room FROM open o JOIN entities e ON e.canonical_name ILIKE '%' || o.candidate || '%' OR e.display_name ILIKE '%' || o.candidate || '%'
        WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = o.query_id AND ex.entity_id = e.id))) WHERE rank <= room""")
def seed_ilike(spark, d):
    return graph_query.seed_like(_entity_candidates(spark, d), table(spark, d, "entities"), _exact(spark, d), SEEDS)


_NAMED = f"edges AS (SELECT r.id, r.source_entity_id, s.canonical_name AS source_name, r.relationship_type, r.target_entity_id, t.canonical_name AS target_name, r.document_id, r.chunk_id, r.page_number FROM relationships r JOIN entities s ON s.id = r.source_entity_id JOIN entities t ON t.id = r.target_entity_id WHERE r.document_id IN (SELECT doc_id FROM documents WHERE {ACL}))"
_HOP1 = f"""{_SEED}, {_NAMED}, h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT DISTINCT s.query_id, e.* FROM edges e JOIN seeds s ON s.entity_id = e.source_entity_id OR s.entity_id = e.target_entity_id)) WHERE n <= 20),
    hop1 AS (SELECT h1.query_id, h1.id, source_entity_id, relationship_type, target_entity_id, document_id, chunk_id, page_number, source_name, target_name, source_name || ' --[' || relationship_type || ']--> ' || target_name AS path,
        CASE WHEN NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h1.query_id AND s.entity_id = h1.source_entity_id) THEN source_entity_id WHEN NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h1.query_id AND s.entity_id = h1.target_entity_id) THEN target_entity_id END AS neighbour FROM h1)"""
_HOP2 = f"""{_HOP1}, used AS (SELECT query_id, count(*) AS used FROM hop1 GROUP BY query_id),
    near AS (SELECT query_id, neighbour, arg_min(path, id) AS parent_path, arg_min(CASE WHEN neighbour = source_entity_id THEN target_entity_id ELSE source_entity_id END, id) AS parent FROM hop1 WHERE neighbour IS NOT NULL GROUP BY ALL),
    b2 AS (SELECT * FROM (SELECT x.*, 50 - u.used AS budget, row_number() OVER (PARTITION BY x.query_id ORDER BY x.id) AS n FROM (SELECT DISTINCT k.query_id, e.* FROM edges e JOIN near k ON k.neighbour = e.source_entity_id OR k.neighbour = e.target_entity_id) x JOIN used u USING (query_id)
        WHERE 50 - u.used > 0 AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.query_id = x.query_id AND h.id = x.id)) WHERE n <= least(greatest(2 * budget, 50), 100)),
    a2 AS (SELECT b2.*, CASE WHEN s.query_id IS NOT NULL THEN source_entity_id ELSE target_entity_id END AS anchor, CASE WHEN s.query_id IS NOT NULL THEN target_entity_id ELSE source_entity_id END AS other, coalesce(s.parent, t.parent) AS parent, coalesce(s.parent_path, t.parent_path) AS parent_path
        FROM b2 LEFT JOIN near s ON s.query_id = b2.query_id AND s.neighbour = source_entity_id LEFT JOIN near t ON t.query_id = b2.query_id AND t.neighbour = target_entity_id),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, anchor ORDER BY id) AS per FROM a2 WHERE other != parent AND NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = a2.query_id AND z.entity_id = a2.other)),
    e2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM c2 WHERE per <= 5),
    hop2 AS (SELECT query_id, id, source_entity_id, relationship_type, target_entity_id, document_id, chunk_id, page_number, parent_path || ' -> ' || relationship_type || ' -> ' || CASE WHEN anchor = source_entity_id THEN target_name ELSE source_name END AS path, anchor FROM e2 WHERE k <= budget)"""


def _seeds(spark, d):
    q = table(spark, d, "eval_questions").select(F.col("id").alias("query_id"), F.get(F.col("expected_pages"), F.lit(0)).getField("document_id").cast("long").alias("document_id"))
    r = table(spark, d, "relationships").groupBy("document_id").agg(F.min_by("source_entity_id", "id").alias("entity_id"))
    return materialize(q.join(r, "document_id").select("query_id", "entity_id").distinct())


def _hops(spark, d):
    edges, seeds = _edges(spark, d), _seeds(spark, d)
    first = materialize(graph_query.hop1(edges, seeds, 20, table(spark, d, "entities")))
    return edges, seeds, first


@query(f"WITH {_HOP1} SELECT query_id, id, path, neighbour FROM hop1")
def hop1_edges(spark, d):
    return graph_query.hop1(_edges(spark, d), _seeds(spark, d), 20, table(spark, d, "entities")).select("query_id", "id", "path", "neighbour")


@query(f"WITH {_HOP2} SELECT query_id, id, path, anchor FROM hop2")
def hop2_edges_capped(spark, d):
    edges, seeds, first = _hops(spark, d)
    return graph_query.hop2(edges, seeds, first, 50, entities=table(spark, d, "entities")).select("query_id", "id", "path", "anchor")


@query(f"WITH {_HOP1}, ends AS (SELECT DISTINCT query_id, unnest([source_entity_id, target_entity_id]) AS entity_id FROM hop1) SELECT query_id, entity_id FROM ends WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = ends.query_id AND s.entity_id = ends.entity_id)")
def connected_entities(spark, d):
    _, seeds, first = _hops(spark, d)
    return graph_query.connected(first, seeds)


_IDS = "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), ','), '') AS {1}"


@query(f"WITH {_HOP1} SELECT query_id, {_IDS.format('chunk_id', 'chunks')}, {_IDS.format('document_id', 'documents')}, {_IDS.format('page_number', 'pages')} FROM hop1 GROUP BY query_id")
def provenance_sets(spark, d):
    return graph_query.provenance(_hops(spark, d)[2])


@query(f"WITH {_HOP1} SELECT DISTINCT h.query_id, c.id AS chunk_id, c.document_id, c.section, d.filename FROM hop1 h JOIN chunks c ON c.id = h.chunk_id JOIN documents d ON d.doc_id = c.document_id WHERE {ACL}")
def provenance_chunks(spark, d):
    """The chunks that found edges come from, with their documents, under access control."""
    first = _hops(spark, d)[2].select("query_id", "chunk_id").distinct()
    docs = table(spark, d, "documents").join(allowed_documents(spark, d).withColumnRenamed("document_id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("document_id"), "filename")
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "section")
    return first.join(c, "chunk_id").join(docs, "document_id").select("query_id", "chunk_id", "document_id", "section", "filename")


@query(f"WITH {_HOP1} SELECT query_id, entity_id, min(id) AS first_edge, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = x.query_id AND s.entity_id = x.entity_id) AS is_seed FROM (SELECT query_id, id, unnest([source_entity_id, target_entity_id]) AS entity_id FROM hop1) x GROUP BY ALL")
def evidence_subgraph_nodes(spark, d):
    _, seeds, first = _hops(spark, d)
    return graph_query.evidence_nodes(first, seeds)


@query("SELECT r.id, CASE WHEN r.source_entity_id = 1 THEN 'outgoing' ELSE 'incoming' END AS direction, s.canonical_name AS source_name, r.relationship_type, t.canonical_name AS target_name FROM relationships r JOIN entities s ON s.id = r.source_entity_id JOIN entities t ON t.id = r.target_entity_id WHERE r.source_entity_id = 1 OR r.target_entity_id = 1")
def entity_relationships_both(spark, d):
    return graph_query.entity_edges(table(spark, d, "relationships"), table(spark, d, "entities"), 1)


@query("SELECT r.id, r.document_id, s.canonical_name AS source_name, r.relationship_type, t.canonical_name AS target_name FROM relationships r JOIN entities s ON s.id = r.source_entity_id JOIN entities t ON t.id = r.target_entity_id")
def document_relationships(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return graph_query.named_edges(table(spark, d, "relationships"), table(spark, d, "entities"), docs).select("id", "document_id", "source_name", "relationship_type", "target_name")


@query("""WITH chosen AS (SELECT id FROM entities WHERE contains(lower(canonical_name), 'core') ORDER BY id LIMIT 20),
    e AS (SELECT * FROM relationships WHERE source_entity_id IN (SELECT id FROM chosen) OR target_entity_id IN (SELECT id FROM chosen) ORDER BY id LIMIT 100)
    SELECT min(id) AS id, source_entity_id, relationship_type, target_entity_id FROM e GROUP BY source_entity_id, relationship_type, target_entity_id""")
def subgraph_view(spark, d):
    return graph_query.subgraph(table(spark, d, "relationships"), table(spark, d, "entities"), "core", None, 20)


@query("SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n FROM entities GROUP BY 1")
def entity_type_histogram(spark, d):
    return graph_query.type_histogram(table(spark, d, "entities"), "entity_type")


@query("SELECT coalesce(relationship_type, 'unknown') AS relationship_type, count(*) AS n FROM relationships GROUP BY 1")
def relationship_type_histogram(spark, d):
    return graph_query.type_histogram(table(spark, d, "relationships"), "relationship_type")


@query("SELECT e.id AS entity_id, e.canonical_name, count(*) AS degree FROM (SELECT source_entity_id AS x FROM relationships UNION ALL SELECT target_entity_id FROM relationships) JOIN entities e ON e.id = x GROUP BY ALL ORDER BY degree DESC, entity_id LIMIT 20")
def degree_top20(spark, d):
    return graph_query.degree_top(skew.edges_per_side(table(spark, d, "relationships")), table(spark, d, "entities"))


@query("SELECT d.doc_id, d.filename, (SELECT count(*) FROM chunks c WHERE c.document_id = d.doc_id) AS n_chunks, (SELECT count(*) FROM relationships r WHERE r.document_id = d.doc_id) AS n_relationships FROM documents d")
def document_inventory(spark, d):
    return graph_query.document_inventory(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "relationships"))


@query("SELECT coalesce(model_used, 'unknown') AS model_used, count(*) AS n FROM chunk_progress GROUP BY 1")
def model_usage(spark, d):
    return graph_query.type_histogram(table(spark, d, "chunk_progress"), "model_used")


_ALIAS = "al AS (SELECT DISTINCT lower(display_name) AS term, lower(canonical_name) AS canonical FROM entities WHERE length(trim(display_name)) > 0 UNION SELECT DISTINCT lower(canonical_name), lower(canonical_name) FROM entities WHERE length(trim(canonical_name)) > 0)"


@query(f"""WITH {_SEED}, {_ALIAS}, q AS (SELECT s.query_id, lower('Who works with ' || e.display_name || '?') AS text FROM seeds s JOIN entities e ON e.id = s.entity_id),
    codes AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+(?:-[a-z0-9]+)+'))) AS term FROM q),
    hits AS (SELECT query_id, canonical, 'code_alias' AS method, 1.0::DOUBLE AS score, length(term) AS len, 0 AS prio FROM codes JOIN al USING (term)
        UNION ALL SELECT query_id, canonical, CASE WHEN term = canonical THEN 'exact' ELSE 'alias' END, CASE WHEN term = canonical THEN 1.0 ELSE 0.98 END::DOUBLE, length(term), CASE WHEN term = canonical THEN 1 ELSE 2 END FROM q JOIN al ON contains(text, term) AND (regexp_matches(term, '[^a-z ]') OR regexp_matches(text, '\\b' || term || '\\b')))
    SELECT query_id, canonical, method, score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, canonical ORDER BY prio, len DESC) = 1""")
def alias_linking(spark, d):
    """A question about each document's entity, by its display name, against all entity names and display names."""
    asked = _seeds(spark, d).join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "display_name"), "entity_id").select("query_id", F.concat(F.lit("Who works with "), "display_name", F.lit("?")).alias("text"))
    e = table(spark, d, "entities")
    names = e.select(F.lower("display_name").alias("term"), F.lower("canonical_name").alias("canonical")).unionByName(e.select(F.lower("canonical_name").alias("term"), F.lower("canonical_name").alias("canonical")))
    return graph_query.link_aliases(asked, names.filter(F.length(F.trim("term")) > 0).distinct())


@query(f"WITH {_SEED} SELECT DISTINCT s.query_id, s.entity_id FROM seeds s WHERE EXISTS (SELECT 1 FROM relationships r JOIN documents d ON d.doc_id = r.document_id WHERE {ACL} AND (r.source_entity_id = s.entity_id OR r.target_entity_id = s.entity_id))")
def linker_rbac(spark, d):
    return graph_query.prune_unseen(_seeds(spark, d), table(spark, d, "relationships"), allowed_documents(spark, d)).select("query_id", "entity_id")


_WSC = "[\\t\\n\\x0b\\f\\r ]"
_CANON = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(display_name, '^{_WSC}+|{_WSC}+$', '', 'g'), '^[''\"`’“”()\\[\\]{{}}]+|[''\"`’“”()\\[\\]{{}}]+$', '', 'g'), '^{_WSC}+|{_WSC}+$', '', 'g'), '{_WSC}+', ' ', 'g')"
_ART = f"CASE WHEN lower(s) LIKE 'the %' AND length(s) > 6 THEN ltrim(substr(s, 5)) WHEN lower(s) LIKE 'a %' AND length(s) > 4 THEN ltrim(substr(s, 3)) WHEN lower(s) LIKE 'an %' AND length(s) > 5 THEN ltrim(substr(s, 4)) ELSE s END"


@query(f"""WITH a AS (SELECT id, entity_type, coalesce({_CANON}, '') AS s FROM entities), b AS (SELECT id, entity_type, s, {_ART} AS t FROM a),
    c AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^(?:u\\.s\\.a\\.|usa|u\\.s\\.|u\\.s\\b|us\\b)\\s*') THEN trim('United States ' || regexp_replace(t, '(?i)^(?:u\\.s\\.a\\.|usa|u\\.s\\.|u\\.s\\b|us\\b)\\s*', '')) ELSE t END AS u FROM b),
    e AS (SELECT *, CASE WHEN regexp_matches(u, '(?i)^(?:e\\.u\\.|eu\\b)\\s*') THEN trim('European Union ' || regexp_replace(u, '(?i)^(?:e\\.u\\.|eu\\b)\\s*', '')) ELSE u END AS v FROM c),
    f AS (SELECT *, CASE WHEN regexp_matches(v, '(?i)^(?:u\\.k\\.|uk\\b)\\s*') THEN trim('United Kingdom ' || regexp_replace(v, '(?i)^(?:u\\.k\\.|uk\\b)\\s*', '')) ELSE v END AS w FROM e)
    SELECT id, w AS canonical FROM f WHERE upper(entity_type) != 'DATE'""")
def canonicalize_entities(spark, d):
    e = table(spark, d, "entities").filter(F.upper("entity_type") != "DATE")
    return e.select("id", text.canonicalize(F.col("display_name"), F.col("entity_type")).alias("canonical"))


_DATE_PAT = "(?i)\\b(" + text._MONTH_ALTERNATIVES + ")\\s*(\\d{1,2}),?\\s*(\\d{4})"


@query(f"SELECT id, CASE WHEN regexp_matches(display_name, '{_DATE_PAT}') THEN " + "CASE lower(substr(regexp_extract(display_name, '" + _DATE_PAT + "', 1), 1, 3)) " + " ".join(f"WHEN '{m[:3].lower()}' THEN '{m}'" for m in text.MONTHS) + f" END || ' ' || regexp_extract(display_name, '{_DATE_PAT}', 2)::INT || ', ' || regexp_extract(display_name, '{_DATE_PAT}', 3) ELSE display_name END AS normalized FROM entities WHERE entity_type = 'DATE'")
def normalize_dates(spark, d):
    return table(spark, d, "entities").filter("entity_type = 'DATE'").select("id", text.normalize_date(F.col("display_name")).alias("normalized"))


def _sql_types(c, types, aliases):
    names = {a: k for k, v in aliases.items() for a in v.split()}
    whens = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in names.items())
    return f"CASE WHEN upper(trim({c})) IN ({', '.join(repr(a) for a in names)}) THEN CASE upper(trim({c})) {whens} END WHEN upper(trim({c})) IN ({', '.join(repr(t) for t in types)}) THEN upper(trim({c})) END"


@query(f"SELECT entity_type AS raw, count(*) AS n, {_sql_types('entity_type', ontology.ENTITY_TYPES, ontology.ENTITY_ALIASES)} AS mapped FROM (SELECT entity_type FROM entities UNION ALL SELECT upper(document_type) FROM documents) GROUP BY ALL")
def map_ontology_types(spark, d):
    raw = table(spark, d, "entities").select(F.col("entity_type").alias("raw")).unionAll(table(spark, d, "documents").select(F.upper("document_type")))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("mapped", ontology.entity_type(F.col("raw")))


@query(f"SELECT relationship_type AS raw, count(*) AS n, {_sql_types('relationship_type', ontology.RELATIONSHIP_TYPES, ontology.RELATIONSHIP_ALIASES)} AS mapped FROM relationships GROUP BY ALL")
def map_relationship_types(spark, d):
    return table(spark, d, "relationships").groupBy(F.col("relationship_type").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("mapped", ontology.relationship_type(F.col("raw")))


def _extractions(spark, d):
    """Extraction JSON made of the stored facts of each chunk: its entities (by display name) and its relationships, some of which repeat, refer to themselves or to names that are not listed."""
    e = table(spark, d, "entities").select("id", "canonical_name", "entity_type", "display_name")
    r = table(spark, d, "relationships").filter("chunk_id IS NOT NULL").select("id", "chunk_id", "document_id", "source_entity_id", "target_entity_id", "relationship_type")
    ends = r.select("chunk_id", F.explode(F.array("source_entity_id", F.when(F.col("id") % 7 != 0, F.col("target_entity_id")))).alias("eid")).filter("eid IS NOT NULL").distinct()
    ents = ends.join(e, ends["eid"] == e["id"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("eid", F.struct(F.trim("canonical_name").alias("name"), F.trim("canonical_name").alias("canonical_name"), "entity_type", F.lit("").alias("description"), F.lit(0.5).alias("confidence")).alias("e")))).alias("es"))
    named = r.join(e.select(F.col("id").alias("source_entity_id"), F.trim("canonical_name").alias("source")), "source_entity_id").join(e.select(F.col("id").alias("target_entity_id"), F.trim("canonical_name").alias("target")), "target_entity_id")
    rels = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("id", F.struct("source", "target", "relationship_type", F.lit("").alias("evidence"), F.lit(0.5).alias("confidence")).alias("r")))).alias("rs"))
    j = ents.join(rels, "chunk_id")
    body = F.to_json(F.struct(F.transform("es", lambda x: x["e"]).alias("entities"), F.transform("rs", lambda x: x["r"]).alias("relationships")))
    raw = j.select("chunk_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))
    return materialize(raw.select("chunk_id", graph_build.parse_extraction(F.col("raw")).alias("x")))


_JUDGED = f"""r AS (SELECT id, chunk_id, source_entity_id AS s, target_entity_id AS t, relationship_type FROM relationships WHERE chunk_id IS NOT NULL),
    ends AS (SELECT DISTINCT chunk_id, eid FROM (SELECT chunk_id, s AS eid FROM r UNION ALL SELECT chunk_id, t FROM r WHERE id % 7 != 0)),
    ent AS (SELECT ends.chunk_id, lower(trim(e.canonical_name)) AS k FROM ends JOIN entities e ON e.id = ends.eid),
    n AS (SELECT r.*, lower(trim(a.canonical_name)) AS sk, lower(trim(b.canonical_name)) AS tk, row_number() OVER (PARTITION BY chunk_id ORDER BY r.id) - 1 AS pos FROM r JOIN entities a ON a.id = r.s JOIN entities b ON b.id = r.t),
    m AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM ent WHERE ent.chunk_id = n.chunk_id AND ent.k = n.sk) THEN 'source_not_found' WHEN NOT EXISTS (SELECT 1 FROM ent WHERE ent.chunk_id = n.chunk_id AND ent.k = n.tk) THEN 'target_not_found' WHEN sk = tk THEN 'self_referential' END AS why FROM n),
    j AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY chunk_id, sk, tk, relationship_type, why IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM m)"""


@query(f"WITH {_JUDGED} SELECT chunk_id, pos, sk AS source, tk AS target, relationship_type FROM j WHERE reason = 'kept'")
def validate_extraction(spark, d):
    """Kept relationships of re-parsed extraction JSON."""
    x = _extractions(spark, d)
    judged = graph_build.judged_relationships(x, graph_build.extracted_entities(x))
    return judged.filter("reason IS NULL").select("chunk_id", "pos", F.lower("source").alias("source"), F.lower("target").alias("target"), "relationship_type")


@query(f"WITH {_JUDGED} SELECT reason, count(*) AS n FROM j GROUP BY reason")
def dropped_reasons(spark, d):
    x = _extractions(spark, d)
    judged = graph_build.judged_relationships(x, graph_build.extracted_entities(x))
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT id, chunk_id, source_entity_id AS s, target_entity_id AS t FROM relationships WHERE chunk_id IS NOT NULL), ends AS (SELECT DISTINCT chunk_id, eid FROM (SELECT chunk_id, s AS eid FROM r UNION ALL SELECT chunk_id, t FROM r WHERE id % 7 != 0)) SELECT ends.chunk_id, count(DISTINCT (lower(e.canonical_name), e.entity_type)) AS n_entities FROM ends JOIN entities e ON e.id = ends.eid GROUP BY ends.chunk_id")
def extracted_entity_counts(spark, d):
    x = _extractions(spark, d)
    kept = graph_build.unique_entities(graph_build.extracted_entities(x))
    return kept.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_entities"))


@query(f"WITH {_JUDGED}, c AS (SELECT DISTINCT chunk_id FROM r) SELECT c.chunk_id, (SELECT count(*) FROM ends WHERE ends.chunk_id = c.chunk_id) AS entities_upserted, (SELECT count(*) FROM j WHERE j.chunk_id = c.chunk_id AND (why IS NULL OR why = 'self_referential')) AS relationships_inserted FROM c")
def chunk_graph_counts(spark, d):
    """What each chunk's extraction result would store."""
    return store.chunk_graph(_results(spark, d))[2]


@query(f"WITH {_JUDGED} SELECT DISTINCT chunk_id, trim(a.canonical_name, ' ') AS source, relationship_type, trim(b.canonical_name, ' ') AS target FROM j JOIN entities a ON a.id = j.s JOIN entities b ON b.id = j.t WHERE why IS NULL OR why = 'self_referential'")
def chunk_graph_facts(spark, d):
    """The facts after all extraction results are stored in empty tables."""
    e, r = store.apply_chunk_graph(store.empty_like(table(spark, d, "entities")), store.empty_like(table(spark, d, "relationships")), _results(spark, d))
    name = lambda side: e.select(F.col("id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(side))
    return r.join(name("source"), "source_entity_id").join(name("target"), "target_entity_id").select("chunk_id", "source", "relationship_type", "target").distinct()


def _results(spark, d):
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "page_number")
    return _extractions(spark, d).join(c, "chunk_id")
