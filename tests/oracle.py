"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

import math
from pathlib import Path

import duckdb


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return None if v is None else str(v)


def connect(folder):
    db = duckdb.connect()
    for p in Path(folder).iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return db


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())


def sql_rows(db, sql):
    rel = db.execute(sql)
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(repr(tuple(canon(r[i]) for i in order)) for r in rel.fetchall())
