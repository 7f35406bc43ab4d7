"""Texts that contain names of a stated set, by one automaton per worker."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of names, or of queries, that every worker holds at a time; more are taken in parts.
MAX_NAME_CHARS = 16_000_000


def in_parts(names: DataFrame, column: str) -> list[DataFrame]:
    """Distinct rows of a stated set without nulls and empty strings in `column`, cut by hash into parts of about MAX_NAME_CHARS characters."""
    names = names.filter(F.length(column) > 0).distinct()
    size = names.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    parts = size // MAX_NAME_CHARS + 1
    return [names.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == i) if parts > 1 else names for i in range(parts)]


def _like(name: str) -> re.Pattern | None:
    """What a name with the wildcards of LIKE matches, or None if it has none."""
    if not re.search(r"[%_\\]", name):
        return None
    parts = re.findall(r"\\.|%|_|[^%_\\]+|\\", name, re.S)
    return re.compile("".join({"%": ".*", "_": "."}.get(x, re.escape(x[1:] if x[0] == "\\" and len(x) > 1 else x)) for x in parts), re.S)


def _lookup(sent, like: bool):
    def run(batches):
        import ahocorasick

        machine, patterns = ahocorasick.Automaton(), []
        for n, qs in sent.value.items():
            pattern = _like(n) if like else None
            if pattern:
                patterns.append((pattern, qs))
            else:
                machine.add_word(n, qs)
        some = len(machine) > 0
        if some:
            machine.make_automaton()
        for b in batches:
            qs, ids = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = (t.as_py() or "").lower()
                found = {q for _, hit in machine.iter(t) for q in hit} if some else set()
                found.update(q for p, own in patterns if p.search(t) for q in own)
                qs += sorted(found)
                ids += [i] * len(found)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qs, pa.string()), "chunk_id": pa.array(ids, pa.int64())})

    return run


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, like: bool = False) -> DataFrame:
    """(query_id, chunk_id) of texts that contain a name of (query_id, name), letter case aside.

    Each text is read once for each part of the names (MAX_NAME_CHARS),
    whatever their number.  With like, % and _ in a name stand for any
    characters and any one.  Null texts and names match nothing.
    """
    src = texts.select(F.col(key).cast("long").alias("chunk_id"), F.col(text).alias("text"))
    out = None
    for part in in_parts(names.select("query_id", "name"), "name"):
        wanted: dict[str, list[str]] = {}
        for q, n in part.collect():
            wanted.setdefault(n.lower(), []).append(q)
        hit = src.mapInArrow(_lookup(names.sparkSession.sparkContext.broadcast(wanted), like), "query_id string, chunk_id long")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word boundaries."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return _word(text[start]) != (before != "" and _word(before)) and _word(text[end - 1]) != (after != "" and _word(after))


def terms_of(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, whole, *columns of terms): which terms (term, ...) stand in the lower-cased texts of a stated set of queries (query_id, text), and whether somewhere at word boundaries.

    The terms, of any number, are read once for each part of the queries
    (MAX_NAME_CHARS), in batches, each as an automaton.
    """
    terms = terms.filter(F.length("term") > 0)
    schema = terms.schema
    kind = "query_id string, whole boolean, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = schema.names.index("term")
    out = None
    for part in in_parts(queries.select("query_id", F.lower("text").alias("text")), "text"):
        sent = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches, sent=sent):
            import ahocorasick

            for b in batches:
                machine, rows = ahocorasick.Automaton(), {}
                for i, t in enumerate(b.column(place).to_pylist()):
                    rows.setdefault(t, []).append(i)
                for t in rows:
                    machine.add_word(t, t)
                if not rows:
                    continue
                machine.make_automaton()
                qs, whole, at = [], [], []
                for q, text in sent.value:
                    found: dict[str, bool] = {}
                    for end, t in machine.iter(text):
                        found[t] = found.get(t, False) or _whole(text, end + 1 - len(t), end + 1)
                    for t, w in found.items():
                        qs += [q] * len(rows[t])
                        whole += [w] * len(rows[t])
                        at += rows[t]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.string()), pa.array(whole, pa.bool_()), *(c.take(take) for c in b.columns)], names=["query_id", "whole", *b.schema.names])

        hit = terms.mapInArrow(run, kind)
        out = hit if out is None else out.unionByName(hit)
    return out
