import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import ontology, text
from skein.functions.acl import AccessContext, acl_predicate, acl_predicate_lenient
from skein.models import embed, hashed_embedding
from skein.operators import chunking, context, dense, evaluation, fusion, gold, graph_build, graph_query, lexical, rerank, store
from skein.pipeline import Corpus, Request
from skein.sources import loaders, sinks
from skein.sources.tables import table
from skein.streaming import ingest


def col(spark, fn, *values, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "ctx, doc, want",
    [
        (("engineering", "employee"), ("engineering", "public", "active"), True), (("engineering", "employee"), ("engineering", "manager", "active"), False), (("engineering", "manager"), ("engineering", "manager", "active"), True),
        (("finance", "employee"), ("engineering", "employee", "active"), False), (("finance", "employee"), ("public", "employee", "active"), True), (("hr", "admin"), ("engineering", "admin", "active"), True),
        (("engineering", "manager"), ("engineering", "manager", "archived"), False), (("engineering", "manager", True), ("engineering", "manager", "archived"), True), (("hr", "admin"), (None, "admin", "active"), True), (("hr", "manager"), (None, "public", "active"), False),
    ],
)
def test_access(spark, ctx, doc, want):
    df = spark.createDataFrame([doc], "department string, access_level string, status string")
    assert df.filter(acl_predicate(AccessContext(*ctx))).count() == want


def test_access_context():
    assert AccessContext(" HR ", " Manager ").allowed_levels == ["public", "employee", "manager"]
    with pytest.raises(ValueError):
        AccessContext("hr", "chief")


def test_lenient_access(spark):
    df = spark.createDataFrame([(" Public ", "strange", "draft"), (None, None, None), ("public", "public", "archived")], "department string, access_level string, status string")
    assert df.filter(acl_predicate_lenient(AccessContext())).count() == 2


def test_text(spark):
    assert col(spark, text.normalize_text, "\x00Hello\x07world!\x0c test-\ncase\n\n\n\nJul. 25, 2023 ", "May 3, 2021", None) == ["Helloworld! testcase\n\nJuly 25, 2023 (Jul. 25, 2023)", "May 3, 2021", None]
    assert col(spark, text.tokens, "The naïve well-known A_b, 3x", "", None) == [["the", "well-known", "a_b", "3x"], [], []]
    assert col(spark, text.heading, "# Intro", "3.1 Results", "SECTION ONE:", "a line", "TWO\nLINES", "12") == ["Intro", "3.1 Results", "SECTION ONE:", None, None, None]
    assert col(spark, lambda c: text.units(c, 20), "short", "one line\nanother line here", "One sentence. And one more of them.", "") == [["short"], ["one line", "another line here"], ["One sentence.", "And one more of them."], [""]]
    assert [len(x) for x in col(spark, lambda c: text.hard_slices(c, 10, 4), "abcdefghijklmnopqrstuvwxyz", "short", "")] == [4, 1, 0]
    assert col(spark, text.redact, "key AIzaSyA12345678901234567890123456789012 in text") == ["key [REDACTED_API_KEY] in text"]
    assert col(spark, text.word_count, " a  b\tc ", " ", "") == [3, 0, 0]


def test_canonical_names(spark):
    names = [(' "BERT" ', "MODEL", "BERT"), ("((PyTorch))", "TECHNOLOGY", "PyTorch"), ("the United States Senate", "ORGANIZATION", "United States Senate"), ("an attention layer", "CONCEPT", "attention layer"), ("U.S. Senate", "ORGANIZATION", "United States Senate"),
             ("the U.S. Senate", "ORGANIZATION", "United States Senate"), ("US Department of Energy", "ORGANIZATION", "United States Department of Energy"), ("EU AI Act", "REGULATION", "European Union AI Act"), ("UK Government", "ORGANIZATION", "United Kingdom Government"),
             ("Jul. 25, 2023", "DATE", "July 25, 2023"), ("Nov 14, 2022", "DATE", "November 14, 2022"), ("2024", "DATE", "2024"), ("  ", "PERSON", ""), (None, "PERSON", ""), ("the", "CONCEPT", "the")]
    df = spark.createDataFrame(names, "n string, t string, want string").select("n", "want", text.canonicalize(F.col("n"), F.col("t")).alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []
    assert col(spark, ontology.entity_type, " company ", "PERSON", "spaceship", None) == ["ORGANIZATION", "PERSON", None, None]
    assert len(ontology.ENTITY_TYPES) == 15 and len(ontology.RELATIONSHIP_TYPES) == 19


def test_chunking():
    p = ["x" * 67, "y" * 68, "z" * 67]
    assert [c[0] for c in chunking.chunk_pages([(1, "\n\n".join(p))], 160, 0)] == ["\n\n".join(p[:2]), p[2]]
    got = chunking.chunk_pages([(1, "# Introduction\n\nSome text.\n\n## Architecture Overview\n\nMore text.")], 100, 0)
    assert [c[1] for c in got] == ["Introduction", "Architecture Overview"] and got[0][0].startswith("# Introduction")
    assert [(c[1], c[2]) for c in chunking.chunk_pages([(1, "ONE\n\na"), (2, "b")], 100, 0)] == [("ONE", 1), ("ONE", 2)]
    parts = chunking.chunk_pages([(1, "\n\n".join(["a" * 30, "b" * 30, "c" * 30]))], 70, 65)
    assert [c[0] for c in parts] == ["a" * 30 + "\n\n" + "b" * 30, "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30] or len(parts) > 1
    assert [len(c[0]) for c in chunking.chunk_pages([(1, "q" * 2000)], 800, 150)] == [800, 800, 700]
    assert max(len(c[0]) for c in chunking.chunk_pages([(1, "A sentence of words. " * 400)], 800, 150)) <= 952
    with pytest.raises(ValueError):
        chunking.check_sizes(100, 100)


def test_chunk_table(spark):
    df = spark.createDataFrame([("d1", "one\n\ntwo"), ("d2", None), ("d3", "  "), ("d4", "p1\fp2")], "id string, t string")
    got = [(r.chunk_id, r.page_number, r.char_count, r.word_count) for r in chunking.chunk_documents(df, "id", "t", by_page=True).orderBy("chunk_id").collect()]
    assert got == [("d1_c0000", 1, 8, 2), ("d4_c0000", 1, 2, 1), ("d4_c0001", 2, 2, 1)]
    assert chunking.ingestion_summary(chunking.chunk_documents(df.limit(0), "id", "t")).first()[:] == (0, 0, 0, 0)


def test_bm25(spark):
    corpus = spark.createDataFrame([(1, "vector search with dense embeddings"), (2, "BM25 lexical search ranks documents"), (3, None), (4, "")], "id long, content string")
    q = spark.createDataFrame([("a", "BM25 lexical search"), ("b", ""), ("c", "unheard"), ("d", None)], "qid string, t string")
    got = lexical.bm25(corpus, "id", "content", q, "qid", "t", 3).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 2, 1), ("a", 1, 2)]
    assert lexical.bm25(corpus, "id", "content", q, "qid", "t", 0).count() == 0
    twice = q.limit(0).unionByName(spark.createDataFrame([("x", "search"), ("y", "search search")], "qid string, t string"))
    s = {r.query_id: r.score for r in lexical.bm25(corpus, "id", "content", twice, "qid", "t", 1).collect()}
    assert abs(s["y"] - 2 * s["x"]) < 2e-4


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "id long, e array<float>")
    got = dense.cosine_topk(v, "id", "e", v.filter("id in (1, 3)"), "id", "e", 2, dim=2).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.similarity) for r in got] == [(1, 1, 1.0), (1, 6, 1.0)]
    assert dense.cosine_topk(v.limit(0), "id", "e", v, "id", "e", 2, dim=2).count() == 0
    assert dense.semantic_argmax(v, "id", "e", v.filter("id = 2"), "id", "e", 0.65, dim=2).first().id == 2


def test_rrf(spark):
    v = spark.createDataFrame([("q", "A", 1), ("q", "B", 2), ("q", "C", 3), ("q", None, 4)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "C", 1), ("q", "A", 2), ("q", "D", 3)], "query_id string, id string, rank int")
    got = fusion.rrf([("vector", v), ("bm25", b)]).orderBy("rank").collect()
    assert [(r.id, r.rrf_score, r.retrieved_by) for r in got] == [("A", 0.032522, "bm25,vector"), ("C", 0.032266, "bm25,vector"), ("B", 0.016129, "vector"), ("D", 0.015873, "bm25")]
    with pytest.raises(ValueError):
        fusion.rrf([("vector", v)], k=0)
    assert fusion.rrf([("vector", v.limit(0))]).count() == 0


def test_evidence_fusion(spark):
    rows = lambda ids: spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(ids)], "query_id string, id long, rank int")
    f = fusion.fuse_evidence(rows([101, 102]), rows([101, 103]), spark.createDataFrame([(101,), (102,), (103,)], "id long"))
    assert {r.id: (r.source, r.retrieved_by) for r in f.collect()} == {101: ("hybrid_graph_vector", "vector,graph"), 102: ("vector", "vector"), 103: ("graph", "graph")}
    assert fusion.fusion_stats(f).first()[1:] == (2, 2, 1, 3)


def test_rerank_and_pack(spark):
    c = spark.createDataFrame([("q", "alpha beta", 1, "nothing", 1), ("q", "alpha beta", 2, "alpha beta", 2), ("q", "alpha beta", 3, "beta alpha", 3)], "query_id string, query string, id long, text string, rank int")
    assert [r.id for r in rerank.rerank(c, top_k=2).orderBy("rank").collect()] == [2, 3]
    model = rerank.model_score(lambda pairs: [float(len(t)) for _, t in pairs])
    assert rerank.rerank(c, model, 1).first().id == 2
    b = spark.createDataFrame([("q", n, n, "H\n", "x" * 150) for n in (1, 2, 3)], "query_id string, rank int, chunk_id long, head string, content string")
    assert context.pack(b, 350).count() == 2 and context.pack(b, 160).count() == 1
    one = context.pack(b.filter("rank = 1").withColumn("content", F.lit("y" * 5000)), 120).first()
    assert one.block.endswith("...\n") and one.used_chars <= 160
    asked = spark.createDataFrame([("q", "what?"), ("none", "who?")], "query_id string, query string")
    said = {r.query_id: (r.answer, r.grounded) for r in context.answer(asked, context.contexts(context.pack(b)), lambda ps: ["see [SOURCE 2]" for _ in ps]).collect()}
    assert said == {"q": ("see [SOURCE 2]", True), "none": (context.NO_EVIDENCE, False)}
    assert col(spark, context.is_refusal, context.NO_EVIDENCE, "fine", None) == [True, False, False]
    assert col(spark, context.source_tags, "a [SOURCE 2] b [SOURCE 10] [SOURCE 2]") == [[2, 10]]


EDGE = "id long, source_entity_id long, source_name string, relationship_type string, target_entity_id long, target_name string, document_id long, chunk_id long, page_number int"


def edge(i, s, t, kind="USES"):
    return (i, s, f"n{s}", kind, t, f"n{t}", 1, i, 1)


def test_traversal(spark):
    seeds = spark.createDataFrame([("q", 1)], "query_id string, entity_id long")
    edges = spark.createDataFrame([edge(101, 1, 2), edge(102, 2, 1), edge(103, 2, 3)], EDGE)
    first = spark.createDataFrame([edge(101, 1, 2), edge(103, 2, 3)], EDGE)
    assert {r.id for r in graph_query.traverse(first, seeds, 2).collect()} == {101, 103}
    assert {(r.id, r.hop) for r in graph_query.traverse(edges, seeds, 2).collect()} == {(101, 1), (102, 1), (103, 2)}
    hub = spark.createDataFrame([edge(1, 1, 2), *[edge(10 + k, 2, 10 + k) for k in range(9)]], EDGE)
    two = graph_query.traverse(hub, seeds, 2).filter("hop = 2").orderBy("id").collect()
    assert [r.id for r in two] == [10, 11, 12, 13, 14] and two[0].path == "n1 --[USES]--> n2 -> USES -> n10"
    assert {r.entity_id for r in graph_query.connected(edges.withColumn("query_id", F.lit("q")), seeds).collect()} == {2, 3}
    for bad in ({"depth": 3}, {"max_results": 0}):
        with pytest.raises(ValueError):
            graph_query.traverse(edges, seeds, **bad)


def test_keywords_and_linking(spark):
    got = col(spark, graph_query.keywords, 'What is "Llama 2 70B" of Stanford University?', "", None, "what is the")
    assert got[0][0] == "Llama 2 70B of Stanford" or "Llama 2 70B" in got[0]
    assert "Stanford University" in got[0] and "What" not in got[0] and got[1:] == [[], [], []]
    q = spark.createDataFrame([("q", "Does Atlas use inc-2026-014 at 99.95%?")], "query_id string, text string")
    a = spark.createDataFrame([("atlas", "product atlas"), ("inc-2026-014", "incident inc-2026-014"), ("99.95%", "99.95% availability"), ("tlas", "wrong"), ("atlas", "atlas")], "term string, canonical string")
    hit = {r.canonical: (r.method, r.score) for r in graph_query.link_aliases(q, a).collect()}
    assert hit == {"product atlas": ("alias", 0.98), "incident inc-2026-014": ("code_alias", 1.0), "99.95% availability": ("alias", 0.98), "atlas": ("exact", 1.0)}


def test_extraction(spark):
    raw = '```json\n{"entities": [{"name": "the BERT", "entity_type": "model", "confidence": 0.5}, {"name": "bert", "canonical_name": "BERT", "entity_type": "MODEL", "description": "d", "confidence": 0.9}, {"name": "X", "entity_type": "spaceship"}, {"name": "Lab", "entity_type": "company", "confidence": 1}], "relationships": [{"source": "BERT", "target": "lab", "relationship_type": "built_by"}, {"source": "bert", "target": "Lab", "relationship_type": "DEVELOPED_BY"}, {"source": "who", "target": "Lab", "relationship_type": "USES"}, {"source": "Lab", "target": "X", "relationship_type": "USES"}, {"source": "the bert", "target": "BERT", "relationship_type": "USES"}, {"source": "BERT", "target": "Lab", "relationship_type": "hugs"}]}\n```'
    df = spark.createDataFrame([(1, raw), (2, ""), (3, "[1]"), (4, None)], "chunk_id long, raw string").select("chunk_id", graph_build.parse_extraction(F.col("raw")).alias("x"))
    e = graph_build.extracted_entities(df)
    u = {r.canonical_name: (r.entity_type, r.confidence, r.description) for r in graph_build.unique_entities(e).collect()}
    assert u == {"BERT": ("MODEL", 0.9, "d"), "Lab": ("ORGANIZATION", 1.0, None)}
    assert [r.reason for r in graph_build.judged_relationships(df, e).orderBy("pos").collect()] == [None, "duplicate", "source_not_found", "target_not_found", "self_referential", "invalid_type"]

    def model(t):
        if t == "bad":
            raise RuntimeError("key AIzaSyA12345678901234567890123456789012 refused")
        return "{}"

    c = spark.createDataFrame([(1, 1, "ok"), (2, 1, " "), (3, 1, "bad")], "id long, document_id long, content string")
    assert [(r.status, r.error) for r in graph_build.extract(c, model).orderBy("chunk_id").collect()] == [("success", None), ("skipped_empty", None), ("error", "key [REDACTED_API_KEY] refused")]


def test_store(spark):
    t = dt.datetime(2025, 1, 1)
    schema = "id long, canonical_name string, entity_type string, display_name string, metadata map<string,string>, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([(1, "A", "MODEL", "a", {"x": "1", "y": "1"}, t, t)], schema)
    new = spark.createDataFrame([(9, " A ", "MODEL", "b", {"y": None, "z": "2"}, t, t), (10, "a", "MODEL", "c", None, t, t), (11, " ", "MODEL", "d", None, t, t)], schema)
    got = {r.canonical_name: (r.id, r.display_name, r.metadata) for r in store.upsert_entities(old, new).collect()}
    assert got == {"A": (1, "b", {"x": "1", "y": None, "z": "2"}), "a": (10, "c", None)}
    chunk = "id long, document_id long, content string, page_number int, section string, chunk_index int, embedding array<float>, created_at timestamp"
    ok = spark.createDataFrame([(1, 1, "a\x00b", 1, None, 0, [0.1, 0.2], t), (2, 1, "c", 1, None, 1, None, t)], chunk)
    assert store.insert_chunks(ok, 2).filter("content = 'ab'").count() == 1
    with pytest.raises(Exception, match="length other than 3"):
        store.insert_chunks(ok, 3).collect()
    docs = spark.createDataFrame([("f\x00", " ", "h", " hr ", None, "")], "filename string, document_type string, content_hash string, department string, access_level string, status string")
    new_id, *row = store.insert_documents(docs, 5).first()
    assert new_id >= 5 and tuple(row) == ("f", " ", "h", "hr", "public", "active")
    assert store.empty_like(ok).count() == 0
    p = spark.createDataFrame([(1, "failed", 2, "timeout x"), (2, "failed", 3, "other"), (3, "processing", 0, None), (4, "pending", 0, None)], "chunk_id long, status string, attempts int, error_message string").withColumn("document_id", F.lit(1)).withColumn("page_number", F.lit(1))
    assert [r.chunk_id for r in store.pending_batch(p, 2).collect()] == [1, 4]
    assert {r.chunk_id: r.status for r in store.reset_states(p, failed_like="timeout").collect()} == {1: "pending", 2: "failed", 3: "pending", 4: "pending"}
    done = store.mark(p, spark.createDataFrame([(4, "completed")], "chunk_id long, new_status string"))
    assert done.filter("chunk_id = 4").first().attempts == 1


def test_metrics(spark):
    df = spark.createDataFrame([([101, 999, 102, 888], [101, 102, 103, 104]), ([999, 42], [42]), ([], []), ([5], []), ([7], [8])], "f array<long>, g array<long>")
    f, g = F.col("f"), F.col("g")
    got = df.select(evaluation.recall_at(f, g, 4).alias("r"), evaluation.hit_at(f, g, 1).alias("h"), evaluation.mrr(f, g).alias("m")).collect()
    assert [tuple(r) for r in got] == [(0.5, 1.0, 1.0), (1.0, 0.0, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    c = spark.createDataFrame([([10, 20, 99], [10, 20, 30])], "c array<long>, g array<long>").select(*evaluation.citation_metrics(F.col("c"), F.col("g"))).first()
    assert c.correctness == pytest.approx(2 / 3) and c.completeness == pytest.approx(2 / 3)
    m = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7], 1, ["a|USES|b", "c|USES|d"], ["b|USES|a"])], "v array<long>, gr array<long>, g array<long>, s int, w array<string>, e array<string>")
    r = m.select(*evaluation.graph_metrics(F.col("v"), F.col("gr"), F.col("g"), F.col("s"), F.col("w"), F.col("e"))).first()
    assert (r.seed_hit, r.relationship_rate, r.unique_graph, r.unique_relevant) == (1.0, 0.5, 2, 2)


def test_gold(spark):
    t = spark.createDataFrame([(1, "About ATLAS and more"), (2, None)], "id long, c string")
    n = spark.createDataFrame([("q", "Atlas"), ("q", None), ("r", "atlas")], "query_id string, name string")
    assert sorted(tuple(r) for r in gold.contained(t, "id", "c", n).collect()) == [("q", 1), ("r", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.md").write_text("intro\n# The Title\nbody")
    (tmp_path / "c.md").write_text("no heading")
    got = {r.filename: r.title for r in loaders.load_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "a", "b.md": "The Title", "c.md": "c"}
    assert loaders.load_text(spark, f"file://{tmp_path}").first().text == "plain � text"
    with pytest.raises(ValueError):
        loaders.load_documents(spark, str(tmp_path), ("doc",))
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "question": "?", "category": "comparison"}]}')
    assert loaders.load_questions(spark, f"file://{tmp_path}/q.json").first().category == "comparison"
    (tmp_path / "bad.json").write_text('{"questions": [{"id": "1", "question": "?", "category": "odd"}]}')
    with pytest.raises(Exception, match="unknown category"):
        loaders.load_questions(spark, f"file://{tmp_path}/bad.json").collect()
    rows = spark.createDataFrame([("a|b", 1)], "name string, n int")
    paths = sinks.write_report("Title", {"Part": rows}, str(tmp_path / "out"))
    assert "a\\|b" in open(paths["markdown"]).read()


def test_models(spark):
    v = hashed_embedding(["a b", "", None, "b a"])
    assert abs((v[0] ** 2).sum() - 1) < 1e-6 and not v[1].any() and not v[2].any() and (v[0] == v[3]).all()
    df = spark.createDataFrame([(i, "word " * i) for i in range(70)], "id long, t string")
    assert embed(df, "id", "t").filter("size(embedding) = 384").count() == 70


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    make = lambda ids: spark.createDataFrame([(i, 1, "t", 1) for i in ids], ingest.CHUNKS).coalesce(1).write.mode("append").parquet(src)
    make([1, 2])
    ingest.run_available(spark, src, ingest.CHUNKS, lambda b: b.select("id"), out, ck)
    make([3])
    ingest.run_available(spark, src, ingest.CHUNKS, lambda b: b.select("id"), out, ck)
    assert ingest.run_available(spark, src, ingest.CHUNKS, lambda b: b.select("id"), out, ck) == 0
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_service(spark, sf):
    for bad in ({"query": " "}, {"query": "x", "top_k": 51}, {"query": "x", "candidate_k": 0}):
        with pytest.raises(ValueError):
            Request(**bad)
    c = Corpus(table(spark, sf, "documents"), table(spark, sf, "chunks"))
    q = spark.createDataFrame([("1", "What did the audit say about the release?"), ("2", "zzzz")], "query_id string, text string")
    rows = {r.query_id: r.grounded for r in c.answer(q, None, AccessContext("engineering", "employee")).collect()}
    assert rows == {"1": True, "2": False}


def test_query_sets_in_parts_find_the_same(spark, sf, monkeypatch):
    """Queries beyond what a worker holds at a time are taken in parts."""
    from skein.plans import common, retrieval_queries

    sorted_rows = lambda df: sorted(map(tuple, df.collect()))
    lexical_, dense_ = (sorted_rows(f(spark, sf, 5, False)) for f in (retrieval_queries._bm25, retrieval_queries._vector))
    linked = lambda: sorted_rows(graph_query.link_aliases(common.questions(spark, sf), spark.createDataFrame([("passage store", "x"), ("gradient", "y")], "term string, canonical string")))
    hits = linked()
    monkeypatch.setattr(lexical, "MAX_QUERY_TERMS", 900)
    monkeypatch.setattr(dense, "MAX_QUERIES", 50)
    monkeypatch.setattr(gold, "MAX_NAME_CHARS", 10_000)
    assert lexical_ and sorted_rows(retrieval_queries._bm25(spark, sf, 5, False)) == lexical_
    assert dense_ and sorted_rows(retrieval_queries._vector(spark, sf, 5, False)) == dense_
    assert hits and linked() == hits


def test_graph_branch_of_the_service(spark, sf):
    """A question that names an entity and shares no word with any text is answered from the edges around that entity."""
    docs, chunks, edges, entities = (table(spark, sf, t) for t in ("documents", "chunks", "relationships", "entities"))
    admin = AccessContext("hr", "admin", True)
    r = edges.filter("chunk_id IS NOT NULL").orderBy("id").first()
    name = "Zzqxv Qqzzx"
    renamed = entities.withColumn("canonical_name", F.when(F.col("id") == r.source_entity_id, name).otherwise(F.col("canonical_name")))
    q = spark.createDataFrame([("1", name), ("2", "qqqq zzzz"), ("3", "  ")], "query_id string, text string")
    got = Corpus(docs, chunks, edges, renamed).ask(q, None, admin, mode="graph_aware")
    d = {x.query_id: x for x in got.diagnostics.collect()}
    assert (d["1"].status, d["1"].graph_status, d["1"].graph_seed_count) == ("success", "success", 1) and d["1"].graph_candidates > 0 == d["1"].vector_candidates
    assert (d["2"].status, d["2"].graph_status) == ("no_evidence", "no_seed_entities_found") and (d["3"].status, d["3"].graph_status, d["3"].graph_seed_count) == ("empty_query", "empty_query", 0)
    assert {x.query_id: x.grounded for x in got.answers.collect()} == {"1": True, "2": False, "3": False}
    cited = got.citations.collect()
    assert {x.query_id for x in cited} == {"1"} and {x.retrieved_by for x in cited} == {"graph"} and len(cited) == d["1"].evidence_count
    none = Corpus(docs, chunks, edges, renamed).ask(q, None, AccessContext("nowhere", "public")).diagnostics.filter("query_id = '1'").first()
    allowed = {x.doc_id for x in docs.filter(acl_predicate(AccessContext("nowhere", "public"))).collect()}
    own = [x for x in edges.filter(f"source_entity_id = {r.source_entity_id} OR target_entity_id = {r.source_entity_id}").collect() if x.document_id in allowed]
    assert none.graph_seed_count == 1 and (none.graph_relationship_count > 0) == bool(own)


def test_reranking_reads_facts_only_in_graph_mode(spark):
    c = spark.createDataFrame([("q", "alpha beta", 1, "alpha here", "", 1), ("q", "alpha beta", 2, "nothing", "[GRAPH PATH]\nalpha --[R]--> beta", 2)], "query_id string, query string, id int, text string, header string, rank int")
    best = lambda mode: [(r.id, r.graph_augmented, r.reranking_mode) for r in rerank.rerank(c, mode=mode, telemetry=True).orderBy("rank").collect()]
    assert best("graph_aware") == [(2, True, "graph_aware"), (1, False, "graph_aware")] and best("baseline") == [(1, False, "baseline"), (2, False, "baseline")]


def test_chunk_graphs(spark):
    kind = "chunk_id long, document_id long, page_number int, x struct<entities:array<struct<name:string,canonical_name:string,entity_type:string,description:string,confidence:double>>,relationships:array<struct<source:string,target:string,relationship_type:string,evidence:string,confidence:double>>>"
    e = [("BERT", "Bert", "MODEL", None, 0.9), ("bert", "BERT-large", "MODEL", "d", 0.5), ("Atlas", "", "PRODUCT", None, None)]
    rows = [(1, 7, 2, (e, [(" BERT ", "atlas", "USES", "ev", 0.4), ("Bert", "ATLAS", "USES", None, 0.4), ("BERT", "unknown", "USES", None, 0.1)])), (2, 7, 3, ([e[2]], [("Atlas", "atlas", "RELATED_TO", None, 1.0)])), (3, 7, 3, None), (4, 7, 3, ([], []))]
    x = spark.createDataFrame(rows, kind)
    entities, relationships, counts = store.chunk_graph(x)
    assert {(r.chunk_id, r.entities_upserted, r.relationships_inserted) for r in counts.collect()} == {(1, 3, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)}
    assert {(r.source.canonical_name, r.target.canonical_name) for r in relationships.filter("chunk_id = 1").collect()} == {("BERT-large", "Atlas")}  # the last one of that name
    old = spark.createDataFrame([(5, "Atlas", "PRODUCT", "ATLAS", {"k": "v"}, None, None)], "id long, canonical_name string, entity_type string, display_name string, metadata map<string,string>, created_at timestamp, updated_at timestamp")
    edges = spark.createDataFrame([], "id long, source_entity_id long, target_entity_id long, relationship_type string, document_id long, chunk_id long, page_number int, metadata map<string,string>, created_at timestamp, updated_at timestamp")
    after, facts = store.apply_chunk_graph(old, edges, x)
    atlas = after.filter("canonical_name = 'Atlas'").first()
    assert atlas.id == 5 and atlas.display_name == "Atlas" and atlas.metadata["k"] == "v" and after.count() == 3 and facts.count() == 2
    again, same = store.apply_chunk_graph(after, facts, x)
    assert {r.id for r in again.collect()} == {r.id for r in after.collect()} and {r.id for r in same.collect()} == {r.id for r in facts.collect()}


def test_suite_matrix(spark):
    one = lambda r: spark.createDataFrame([(r, 0.5)], "recall double, mrr double")
    assert sinks.suite_matrix({"a": one(0.2), "b": one(0.4)}, ["recall", "mrr"]) == [{"suite": "a", "recall": 0.2, "mrr": 0.5}, {"suite": "b", "recall": 0.4, "mrr": 0.5}, {"suite": "macro average", "recall": 0.3, "mrr": 0.5}]


def test_headings_of_the_packer_and_of_expressions_agree(spark, sf):
    p = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.explode(text.paragraphs(F.col("text"))).alias("p")).distinct()
    rows = p.select("p", text.heading(F.col("p")).alias("h")).collect()
    assert len([r for r in rows if r.h]) > 20 and [r for r in rows if chunking.title_of(r.p) != r.h] == []


def test_vectors_of_two_models_are_not_consistent(spark):
    df = spark.createDataFrame([([1.0, 0.0], "a", "m"), ([0.0, 1.0], "a", "n"), (None, "b", None)], "v array<float>, provider string, model string")
    said = lambda *same: dense.vector_consistency(df, "v", 2, same).first().consistent
    assert said() and said("provider") and not said("provider", "model")


def test_pages_are_normalised_one_by_one(spark):
    assert col(spark, loaders._pages, "one test-\ncase\x07\n\n\n\nx\f\fJul. 25, 2023") == ["one testcase\n\nx\f\fJuly 25, 2023 (Jul. 25, 2023)"]
