import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connect, spark_rows, sql_rows  # noqa: E402

from skein import llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query(spark, sf, name):
    assert spark_rows(llm.QUERIES[name](spark, sf)) == sql_rows(connect(sf), llm.SQL[name])


def test_columns(spark, sf):
    want = {
        "p1_found": ["id", "cut_at"], "p4_found": ["query_id", "chunk_id"], "p5_found": ["id_a", "id_b"], "p6_found": ["id_a", "id_b"], "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
    }
    assert set(want) <= set(llm.QUERIES)
    for name, columns in want.items():
        assert llm.QUERIES[name](spark, sf).columns == columns
