import itertools
import random

import numpy as np

from skein.llm import subjects as S
from skein.sources.tables import table

DOC = "doc_id long, text string, subject string, share int"
LABEL = "doc_id long, subject string, annotator string, text string"
TERMS = {"law": ["contract clause", "appeal court", "statute book"], "energy": ["wind turbine", "heat pump", "power grid"], "sport": ["goal keeper", "penalty kick", "final match"]}


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = r.sample(list(TERMS), r.choice([1, 1, 2]))
        said = [f"The team noted that the {r.choice(TERMS[own[k % len(own)]])} was checked in {r.randint(1990, 2020)}." for k in range(12)]
        docs.append((i, "# Title of it\n\n" + " ".join(said), "x", 0))
        truth[i] = set(own)
    return docs, truth


def test_held_out_accuracy_with_dirty_labels(spark):
    docs, truth = corpus(400, 1)
    r = random.Random(2)
    labels = []
    for i in range(200):
        for s in truth[i]:
            labels.append((i, r.choice([s, f" {s}", s.upper()]) if r.random() > 0.05 else "law", f"reader_{i % 7}", "t"))
    labels += [(0, None, "a", "t"), (None, "law", "a", "t"), (1, "no such", "a", "t"), labels[0], labels[1]]
    docs += [(9000, None, "x", 0), (9001, "", "x", 0), (9002, "No words here that tell anything at all.", "x", 0), (None, docs[0][1], "x", 0), (9003, docs[5][1] * 300, "x", 0)]
    subjects = spark.createDataFrame([(s, s) for s in TERMS], "subject string, title string")
    got = {}
    for row in S.subjects_of(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), subjects).collect():
        got.setdefault(row.doc_id, set()).add(row.subject)
    assert sum(got.get(i, set()) == truth[i] for i in range(200, 400)) >= 195
    assert got[9003] == truth[5] and not {9000, 9001, 9002} & set(got)


def test_without_labels_or_documents(spark):
    subjects = spark.createDataFrame([(s, s) for s in TERMS], "subject string, title string")
    docs, _ = corpus(3, 1)
    none = spark.createDataFrame([], LABEL)
    assert S.subjects_of(spark.createDataFrame(docs, DOC), none, subjects).count() == 0
    assert S.subjects_of(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "law", "a", "t")], LABEL), subjects).count() == 0


def test_sentences():
    assert S.sentences("# A heading\n\nIt is joined by the shared cont-\nrast agent. Yes.\n\nPage 2\n\nIs this one, too?") == [["it", "is", "joined", "by", "the", "shared", "contrast", "agent"], ["is", "this", "one", "too"]]
    assert S.sentences(None) == S.sentences(" ") == []


def test_labels_agree_with_the_whole_table(spark, sf):
    """The documents' own labels, noisy and used for fitting, must mostly come out; they guard the production path."""
    labels = {}
    for r in S.clean_labels(table(spark, sf, "subject_labels"), table(spark, sf, "subjects")).collect():
        labels.setdefault(r.doc_id, set()).add(r.subject)
    got = {}
    for r in S.p10_found(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(bool(got.get(d, set()) & s) for d, s in labels.items()) >= 0.6 * len(labels)


def random_rows(seed, n=400, items=9, subjects=3):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k = r.randrange(subjects)
        own = {x for x in range(items) if r.random() < (0.6 if x % subjects == k else 0.2)}
        w = np.zeros(subjects)
        w[k] = 1.0
        rows.append((tuple(sorted(own)), 1, w))
    return rows


def test_growth_against_all_itemsets():
    """Every telling itemset is found with its counts, but for those as large as without an item, and beyond saturated ones."""
    rows, prior = random_rows(4), np.full(3, 1 / 3)
    got = {}
    for g in range(4):  # groups see sentences up to their last item only
        cut = []
        for items, n, w in rows:
            last = max((k for k, x in enumerate(items) if x % 4 == g), default=None)
            if last is not None:
                cut.append((items[: last + 1], n, w))
        for b, n, w in S.grow(S.Tree(S._once(cut)), lambda x, g=g: x % 4 == g, prior, 8, 8):
            assert tuple(sorted(b)) not in got
            got[tuple(sorted(b))] = (n, w.tolist())
    every = {}
    for k in range(1, 7):
        for body in itertools.combinations(range(9), k):
            own = [w for items, _, w in rows if set(body) <= set(items)]
            if len(own) >= 8:
                every[body] = (len(own), np.sum(own, axis=0).tolist())
    assert all(every[b] == v for b, v in got.items())
    share = {b: (np.array(w) + prior) / (n + 1) for b, (n, w) in every.items()}
    ours = S.prune({b: share[b] for b in got}, prior)
    assert ours and set(ours) == set(S.prune(share, prior)) and len([b for b in ours if len(b) > 1]) > 3


def test_repeated_long_sentences_do_not_explode():
    w = np.array([0.7, 0.3])
    rows = [(tuple(range(60)), 40, 40 * w), (tuple(range(30)), 10, 10 * w)]
    assert len(list(S.grow(S.Tree(rows), lambda x: True, np.array([0.5, 0.5]), 8, 8))) < 3_000


def test_pruning_by_every_part():
    prior = np.array([0.1, 0.1])
    v = lambda a: np.array([a, 0.05])
    found = {("a",): v(0.5), ("b",): v(0.42), ("a", "b"): v(0.7), ("c",): v(0.2), ("a", "c"): v(0.8), ("a", "b", "c"): v(0.81), ("b", "c"): v(0.55), ("d",): v(0.41), ("d", "e"): v(0.42)}
    rules = S.prune(found, prior)
    assert set(rules) == {("a",), ("b",), ("a", "b"), ("a", "c"), ("b", "c"), ("d",)}


def test_curve_of_held_out_sentences():
    e = np.linspace(-2, 4, 30)
    n = np.full(30, 100.0)
    a, b = S._platt(e, n, n / (1 + np.exp(-(0.5 * e - 0.3))))
    assert abs(a - 0.5) < 0.02 and abs(b + 0.3) < 0.02
    assert S._platt(e[:1], np.array([10.0]), np.array([4.0])) == (1.0, 0.0)


def test_scorer_against_plain_matching():
    r = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "in", "omega"]
    rules = {("alpha",): [2.0, -1.0], ("alpha beta",): [3.0, 0.0], ("gamma", "of delta"): [0.0, 2.5], ("in omega", "beta", "delta"): [1.0, 1.5], ("omega",): [0.5, 0.6], ("delta", "omega"): [0.1, 3.0]}
    model = {"subjects": ["x", "y"], "rules": {k: np.array(v, np.float32) for k, v in rules.items()}, "curve": (1.0, 0.0)}
    texts = [None, "", "alpha beta"] + [" ".join(r.choices([*vocabulary, "7", ".", ". ", "\n\n", "! "], k=60)) + r.choice(["", "."]) for _ in range(80)]
    e, doc, count = S.Scorer(model).evidence(texts)
    want, where = [], []
    for d, t in enumerate(texts):
        for ws in S.sentences(t):
            have = S.items_of(ws) | {w for w in ws}
            hit = [v for b, v in rules.items() if set(b) <= have]
            if hit:
                want.append(np.max(hit, axis=0)), where.append(d)
    assert np.allclose(e, want) and doc.tolist() == where and count.tolist() == [len(S.sentences(t)) for t in texts]


def test_nothing_is_found_without_growth(spark, sf, monkeypatch):
    """All rules, those of one item too, come from the trees."""
    monkeypatch.setattr(S, "_mine", lambda groups, prior: lambda batches: iter(()))
    assert S.p10_found(spark, sf).count() == 0
