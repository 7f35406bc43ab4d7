import tracemalloc

import numpy as np
import pytest

from skein.llm import vectors as V
from skein.sources.tables import table


def brute(rows, least, k=5):
    keep = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == V.DIM and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids = np.array([i for i, _ in keep])
    x = np.stack([v / np.linalg.norm(v) for _, v in keep])
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for a in range(len(ids)):
        best = np.lexsort((ids, -s[a]))[:k]
        out |= {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in best if s[a, b] >= least}
    return out


def test_whole_table(spark, sf):
    rows = [(r.id, r.embedding) for r in table(spark, sf, "chunks").select("id", "embedding").collect()]
    want = brute(rows, 0.85)
    got = [tuple(r) for r in V.p6_found(spark, sf).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.97 * len(want) and len(set(got) - want) <= 0.03 * len(want)


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, V.DIM))
    rows = [(i, [float(x) for x in np.float32(base[i % 40] + 0.1 * r.normal(size=V.DIM))]) for i in range(200)]
    hot = [float(x) for x in np.float32(r.normal(size=V.DIM))]
    rows += [(1000 + i, hot) for i in range(100)]  # a third of all rows
    rows += [(2000, None), (2001, [0.0] * V.DIM), (2002, [1.0] * 10), (2003, [float("nan")] * V.DIM), (2004, [None] * V.DIM), (None, hot), (2005, [x * 2 for x in rows[0][1]])]
    return rows, spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "id long, embedding array<float>, class_id int, h0 string")


def test_odd_vectors_and_a_hot_class(odd):
    rows, df = odd
    want = brute(rows, 0.85)
    got = {tuple(r) for r in V.similar_pairs(df, "id", "embedding", 0.85).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert sum(a >= 1000 and b < 2000 for a, b in got) <= 6 * 100  # no pairing out of the hot class


def test_tiles_find_the_same(odd, monkeypatch):
    _, df = odd
    one = {tuple(r) for r in V.similar_pairs(df, "id", "embedding", 0.85).collect()}
    monkeypatch.setattr(V, "TILE", 16)
    assert {tuple(r) for r in V.similar_pairs(df, "id", "embedding", 0.85).collect()} == one


def test_empty(spark):
    df = spark.createDataFrame([], "id long, embedding array<float>")
    assert V.similar_pairs(df, "id", "embedding", 0.85).count() == 0
    one = spark.createDataFrame([(1, [1.0] * V.DIM)], "id long, embedding array<float>")
    assert V.similar_pairs(one, "id", "embedding", 0.85).count() == 0


def test_codes_approximate():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = V.train(x, 16, len(x))
    home = np.argmax(x @ books.coarse.T - 0.5 * (books.coarse**2).sum(1), axis=1)
    codes, scale = V.beam_codes(x, home, books)
    e = V.estimate(x[:200], home, codes, scale, books)
    exact = x[:200] @ x.T
    assert np.corrcoef(e.ravel(), exact.ravel())[0, 1] > 0.9


def test_nearest_recall_on_the_whole_table(spark, sf):
    rows = [(r.id, np.array(r.embedding, np.float64)) for r in table(spark, sf, "chunks").select("id", "embedding").collect() if r.embedding is not None and len(r.embedding) == V.DIM and any(r.embedding)]
    ids = np.array([i for i, _ in rows])
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    got = {}
    for r in V.p6_knn(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.similarity)
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.round(x @ x[i], 6)
        s[i] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits += len(best & {a for a, _ in got[ids[i]].values()})
        n += 5
        assert sorted(got[ids[i]]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * n
    assert set(got) == set(ids[ids % 20 == 0].tolist())


def test_nearest_with_odd_vectors(odd):
    _, df = odd
    got = V.nearest(df, "id", "embedding", df["id"].isin([0, 1000, 2000, 2003])).collect()
    assert {r.query_id for r in got} == {0, 1000} and {r.id for r in got if r.query_id == 1000} == {1001, 1002, 1003, 1004, 1005}
    assert V.nearest(df.limit(0), "id", "embedding", df["id"] == 1).count() == 0


def near_copies(n, share, cosine, seed=11):
    """n vectors, a share of them with about this cosine to each other."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, V.DIM)) / np.sqrt(V.DIM)
    hot = int(n * share)
    centre = r.normal(size=V.DIM)
    x[:hot] = np.sqrt(cosine) * centre / np.linalg.norm(centre) + np.sqrt(1 - cosine) * x[:hot]
    return [(i, [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("cosine", [0.87, 0.98])
def test_a_third_of_near_copies(spark, monkeypatch, cosine):
    monkeypatch.setattr(V, "TILE", 512)
    rows = near_copies(4500, 1 / 3, cosine)
    got = {tuple(r) for r in V.similar_pairs(spark.createDataFrame(rows, "id long, embedding array<float>").repartition(8), "id", "embedding", 0.85).collect()}
    assert got == brute(rows, 0.85)


def test_nearest_among_a_third_of_near_copies(spark):
    rows = near_copies(6000, 1 / 3, 0.93)
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(8)
    got = {(r.query_id, r.rank): r.id for r in V.nearest(df, "id", "embedding", df["id"] % 20 == 0).collect()}
    x = np.stack([np.array(v) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x[::20] @ x.T, 6)
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -2
    want = {(20 * i, n + 1): int(b) for i, row in enumerate(s) for n, b in enumerate(np.lexsort((np.arange(len(x)), -row))[:5])}
    assert got == want


def test_more_lists_than_words_of_one_codebook(spark, sf, monkeypatch):
    """The second coarse codebook, which production sizes beyond two million rows need, finds the same."""
    rows = [(r.id, r.embedding) for r in table(spark, sf, "chunks").select("id", "embedding").collect()]
    want = brute(rows, 0.85)
    monkeypatch.setattr(V, "PER_WORD", 40)
    sizes = []
    train = V.train
    monkeypatch.setattr(V, "train", lambda *a, **k: sizes.append(train(*a, **k)) or sizes[-1])
    got = {tuple(r) for r in V.p6_found(spark, sf).collect()}
    assert len(sizes[0].sub) >= 4 and sizes[0].lists == len(sizes[0].top) * len(sizes[0].sub)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_summed_codewords():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = V.train(x, 200, 500)
    lists = np.arange(books.lists)
    c = books.coarse
    assert len(books.top) == 62 and len(books.sub) == 4 and len(c) == 248
    assert np.allclose(books.fit(x), x @ c.T - 0.5 * (c * c).sum(1), atol=1e-5)
    assert np.allclose(books.cross(lists), c @ books.fine.T, atol=1e-5) and np.allclose(2 * books.half, (c * c).sum(1), atol=1e-5)


def test_training_holds_few_products_at_once():
    """As many lists as tables of many GB have; all products of this sample with them are 537 MB."""
    x = np.random.default_rng(6).normal(size=(8192, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    books = V.train(x, 16_384, 26_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert books.lists == 16_384 and len(books.begin) and peak < 150e6


def recall(got, rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.stack([np.array(v, np.float64) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.id)
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -2
        hits += len(mine[ids[i]] & set(ids[np.argsort(-s)[:k]].tolist()))
        n += k
    return hits / n


def test_nearest_by_lists_over_many_regions(spark, monkeypatch):
    """Tables of scale 0.01 in tiles far smaller than in production, so that queries meet a part of the rows."""
    monkeypatch.setattr(V, "KNN_TILE", 256)
    chunks = table(spark, "/root/testdata/sf0.01", "chunks")
    rows = [(r.id, r.embedding) for r in chunks.select("id", "embedding").collect() if r.embedding is not None and len(r.embedding) == V.DIM and any(r.embedding)]
    got = V.nearest_by_lists(chunks, "id", "embedding", chunks["id"] % 20 == 0).collect()
    assert len(got) == len({(r.query_id, r.id) for r in got}) == len({(r.query_id, r.rank) for r in got}) and recall(got, rows) >= 0.9


def test_nearest_by_lists_among_a_third_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "KNN_TILE", 512)
    rows = [r for r in near_copies(4500, 1 / 3, 0.93) if r[0] < 1500]
    noise = np.random.default_rng(4).normal(size=(30, V.DIM))
    rows += [(i, [float(y) for y in v]) for i, v in enumerate(noise[np.arange(3000) % 30] + 0.5 * np.random.default_rng(5).normal(size=(3000, V.DIM)), 1500)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(8)
    assert recall(V.nearest_by_lists(df, "id", "embedding", df["id"] % 20 == 0).collect(), rows) >= 0.9
    assert V.nearest_by_lists(df.limit(0), "id", "embedding", df["id"] == 1).count() == 0


def test_repeated_rows_count_once(spark, odd):
    rows, df = odd
    twice = df.unionByName(df.filter("id % 3 = 0"))
    pairs = lambda x: sorted(tuple(r) for r in V.similar_pairs(x, "id", "embedding", 0.85).collect())
    near = lambda x: sorted(tuple(r) for r in V.nearest_by_lists(x, "id", "embedding", x["id"] % 20 == 0).collect())
    assert pairs(twice) == pairs(df) and near(twice) == near(df)
