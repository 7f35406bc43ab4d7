import itertools
import random

import numpy as np

from skein.llm import near_duplicates as N
from skein.sources.tables import table


def brute(rows, least=0.6):
    sets = {}
    for i, t in rows:
        w = N.words(t)
        if i is not None and len(w) >= 20:
            sets[i] = set(zip(w, w[1:]))
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= least * len(x | y):
            out.add((a, b))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "id long, content string, rep string, h0 int")
    return sorted(tuple(r) for r in N.row_pairs(*N.near_duplicate_classes(df, "id", "content", **kw)).collect())


def test_golay_code_covers_every_word_once():
    g = N._golay(3)
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000).astype(np.uint32)
    anchors = np.unique((words ^ g.leader[g.syndrome(words)]))
    assert (g.syndrome(anchors) == 0).all()
    distance = np.bitwise_count(words ^ (words ^ g.leader[g.syndrome(words)]))
    assert distance.max() == 3
    row, near = g.near(words)
    homes = g.home(words)
    assert all(homes[i] in near[row == i] for i in range(50))
    assert abs(len(row) / len(words) - 71.04) < 0.5
    # any word within three bits is replicated to the home of the other
    other = words ^ np.uint32(0b100000010001)
    r, a = g.near(other)
    assert all(homes[i] in a[r == i] for i in range(200))


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


def test_edits_copies_and_odd_texts(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = [(1000, None), (1001, ""), (1002, "too short"), (None, "x " * 50), (1003, "same word " * 30), (1004, "same word " * 31), (1005, " ".join(vocabulary) * 20)]
    for k in range(60):
        base = r.choices(vocabulary, k=r.randint(25, 120))
        rows.append((3 * k, " ".join(base)))
        rows.append((3 * k + 1, edited(r, base, max(1, len(base) // 25))))
        rows.append((3 * k + 2, " ".join(base).upper() if k % 2 else edited(r, base, len(base) // 4)))
    rows += [(2000 + i, "a hot text that stands in a third of all rows and says the very same thing in every one of them over again") for i in range(12)]
    want = brute(rows)
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.98 * len(want)


def test_hot_blocks_dealt_by_anchors_find_the_same(spark, monkeypatch):
    """A third of the rows are near-copies of one text, so their blocks are hot; here they are dealt to several tasks."""
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    hot = r.choices(vocabulary, k=80)
    rows = [(500 + i, edited(r, hot, 2)) for i in range(80)]
    for k in range(80):
        base = r.choices(vocabulary, k=60)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(r, base, 3))]
    one = found(spark, rows)
    want = brute(rows)
    assert set(one) <= want and len(one) >= 0.99 * len(want)
    dealt = []
    blocks = N._hot_blocks
    monkeypatch.setattr(N, "HOT_BLOCK", 20)
    monkeypatch.setattr(N, "SAMPLE", 1)
    monkeypatch.setattr(N, "_hot_blocks", lambda classes: dealt.append(blocks(classes)) or dealt[-1])
    assert found(spark, rows) == one
    assert len(dealt[0][0]) > 10 and dealt[0][1].max() >= 128


def test_compare_in_steps_finds_the_same(monkeypatch):
    r = np.random.default_rng(3)
    n = 6000
    e = np.empty(n, N._ENTRY)
    e["rep"] = r.permutation(n)
    prints = r.integers(0, 1 << 23, 40).astype(np.uint64)[r.integers(0, 40, n)] ^ (np.uint64(1) << r.integers(0, 23, n).astype(np.uint64))
    block = np.where(r.random(n) < 0.3, 7, r.integers(0, 900, n)).astype(np.uint64)
    e["word"] = block << np.uint64(24) | np.uint64(1 << 23) | prints
    whole = set(zip(*(x.tolist() for x in N.compare(e, 3))))
    monkeypatch.setattr(N, "STEP", 100)
    assert set(zip(*(x.tolist() for x in N.compare(e, 3)))) == whole
    want = {(min(e["rep"][i], e["rep"][j]), max(e["rep"][i], e["rep"][j])) for b in np.unique(block) for i, j in itertools.combinations(np.flatnonzero(block == b), 2) if np.bitwise_count(prints[i] ^ prints[j]) <= 3}
    assert whole == want


def test_empty(spark):
    assert found(spark, []) == []


def test_whole_table_recall(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "chunks").select("id", "content").collect()]
    want = brute(rows)
    got = {tuple(r) for r in N.p7_found(spark, sf).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_pairs_near_the_threshold(spark):
    r = random.Random(8)
    rows = []
    for k in range(600):
        base = [f"v{r.randrange(10**6)}" for _ in range(100)]
        other = [f"w{r.randrange(10**6)}" if i % 8 == 3 and i < 96 else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = found(spark, rows)
    assert set(got) <= {(2 * k, 2 * k + 1) for k in range(600)}
    assert len(got) >= 0.97 * 600, len(got)


def test_repeated_rows_count_once(spark):
    r = random.Random(12)
    rows = []
    for k in range(20):
        base = [f"v{r.randrange(3000)}" for _ in range(60)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, edited(r, base, 3)), (3 * k + 2, " ".join(base))]
    once = found(spark, rows)
    assert len(once) == 60 and found(spark, rows + rows[::2]) == once
