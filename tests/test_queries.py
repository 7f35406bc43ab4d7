import importlib

import pytest
from oracle import connect, spark_rows, sql_rows

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    cols, rows = spark_rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert (cols, rows) == sql_rows(db, SQL[name])
    else:
        assert cols


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "rrf_score", "rank", "retrieved_by"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("lost", [["question"], ["question", "expected_source_chunks"], ["question", "expected_pages"]])
def test_answers_from_dense_and_graph_candidates(spark, tmp_path, sf, lost):
    """Words that no chunk has, and no vector or no document for the graph: the other branches still answer."""
    from pathlib import Path

    from pyspark.sql import functions as F

    for p in Path(sf).iterdir():
        if p.name != "eval_questions.parquet":
            (tmp_path / p.name).symlink_to(p)
    asked = spark.read.parquet(f"{sf}/eval_questions.parquet")
    asked = asked.withColumns({c: F.lit("zzzz qqqq") if c == "question" else F.lit(None).cast(asked.schema[c].dataType) for c in lost})
    asked.write.parquet(str(tmp_path / "eval_questions.parquet"))
    assert any(r.grounded for r in QUERIES["rag_answer"](spark, str(tmp_path)).collect())
