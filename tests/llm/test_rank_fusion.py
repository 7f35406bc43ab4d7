from skein.llm import rank_fusion as R

SCHEMA = "query_id long, chunk_id long, a double, b double, logged_at int, _group string, fused int"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)


def ranked(spark, data):
    f = R.fuse_scores(rows(spark, data), "query_id", "chunk_id", ("a", "b"), "logged_at")
    return {(r.query_id, r.chunk_id): (r.rank_a, r.rank_b) for r in f.collect()}, {r.query_id: r.chunk_id for r in R.first_of_group(f, "query_id", "chunk_id", ("a", "b")).collect()}


def test_scales_missing_scores_ties_and_repeats(spark):
    nan = float("nan")
    data = [
        (1, 1, 1e9, 0.1, 0), (1, 2, 5.0, 0.9, 0), (1, 3, 4.0, 0.8, 0),  # the widest range does not decide
        (2, 1, None, 0.9, 0), (2, 2, 3.0, None, 0), (2, 3, 2.0, 0.8, 0), (2, 3, 2.0, 0.8, 5),  # missing: lowest; logged twice
        (3, 7, None, None, 0), (3, 5, None, nan, 0),  # nothing known: the smaller id
        (4, 1, 1.0, 1.0, 0), (4, 1, 9.0, 9.0, 1), (4, 2, 5.0, 5.0, 0),  # the newest row counts
        (None, 1, 1.0, 1.0, 0), (5, None, 1.0, 1.0, 0),
    ]
    ranks, first = ranked(spark, data)
    assert ranks[1, 1] == (1, 3) and ranks[1, 2] == (2, 1) and ranks[2, 1] == (2, 1) and ranks[2, 2] == (1, 2) and ranks[2, 3] == (2, 2)
    assert ranks[3, 5] == ranks[3, 7] == (1, 1)
    assert first == {1: 2, 2: 1, 3: 5, 4: 1}


def test_one_hot_group_against_sorting(spark):
    import random

    r = random.Random(4)
    data = [(9 if i % 3 else i % 5, i, float(r.randint(0, 40)) if r.random() > 0.1 else None, r.random(), 0) for i in range(600)]
    ranks, first = ranked(spark, data)
    for q in {d[0] for d in data}:
        own = [d for d in data if d[0] == q]
        low = min((d[2] for d in own if d[2] is not None), default=0.0)
        score = {d[1]: (d[2] if d[2] is not None else low, d[3]) for d in own}
        want = {i: tuple(1 + sum(o[k] > s[k] for o in score.values()) for k in (0, 1)) for i, s in score.items()}
        assert {i: ranks[q, i] for i in score} == want
        assert first[q] == min(want, key=lambda i: (-round(1 / (60 + want[i][0]) + 1 / (60 + want[i][1]), 15), min(want[i]), i))


def test_empty(spark):
    assert ranked(spark, []) == ({}, {})
