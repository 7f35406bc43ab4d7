"""Operators for text corpora and language-model data.

Nothing outside this subpackage imports it.  QUERIES and SQL collect the
queries of its modules.
"""

import importlib

QUERIES: dict = {}
SQL: dict = {}

for _name in ("splitting", "rank_fusion", "tokenizing", "leakage", "near_duplicates", "vectors", "names", "subjects"):
    try:
        _m = importlib.import_module(f"skein.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"skein.llm.{_name}":
            raise
        continue
    QUERIES.update(getattr(_m, "QUERIES", {}))
    SQL.update(getattr(_m, "SQL", {}))
