import random

import pytest

from skein.llm import leakage as L
from skein.sources.tables import table


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_myers_against_the_plain_recurrence():
    r = random.Random(1)
    for _ in range(300):
        p = [r.choice("abc") for _ in range(r.randint(1, 12))]
        t = [r.choice("abc") for _ in range(r.randint(0, 30))]
        assert L.myers(p, t, 12)[0] == plain_distance(p, t)


def brute(docs, items, run=12):
    at = {}
    for i, *texts in items:
        for t in texts:
            w = L.words(t)
            for k in range(len(w) - run + 1):
                at.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, x) for d, t in docs for w in [L.words(t)] for k in range(len(w) - run + 1) for x in at.get(tuple(w[k : k + run]), ())}


def test_whole_tables_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "eval_questions").select("id", "question", "expected_answer").collect()]
    got = [tuple(r) for r in L.p9_found(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)


def test_edits_hyphens_nulls_and_repeats(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([("a", text, None), ("b", None, ""), (None, text, text), ("c", "too short", text.upper())], "id string, question string, expected_answer string")
    docs = spark.createDataFrame(
        [
            (1, f"x {text.replace('seven', 'se-  ' + chr(10) + ' ven')} y", 0), (2, text.replace("six", "sixty"), 0), (3, None, 0), (4, "", 0),
            (5, text, 0), (5, text, 0), (6, "two three four five six seven eight nine ten eleven twelve", 0), (7, "word " * 50_000 + text.replace(" ", ",\r\n"), 0),
        ],
        "doc_id long, text string, item_id int",
    )
    exact = sorted(tuple(r) for r in L.leaks(docs, items, L.TEXTS, exact=True).collect())
    assert exact == sorted((d, i) for d in (1, 5, 5, 7) for i in "ac")
    near = {tuple(r) for r in L.leaks(docs, items, L.TEXTS).collect()}
    assert {d for d, _ in near} == {1, 2, 5, 6, 7}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "id string, question string, expected_answer string")
    assert L.leaks(docs, items, L.TEXTS).collect() == []


def test_items_in_parts_find_the_same(spark, sf, monkeypatch):
    """Items beyond what a worker may hold at a time are taken in parts."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_questions")
    whole = sorted(tuple(r) for r in L.leaks(docs, items, L.TEXTS).collect())
    monkeypatch.setattr(L, "MAX_ITEM_CHARS", 15_000)
    assert whole and sorted(tuple(r) for r in L.leaks(docs, items, L.TEXTS).collect()) == whole
