import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.functions.ranking import competition_ranks, running_total
from skein.operators import incremental, skew

T0 = dt.datetime(2025, 1, 1)
LOG = "chunk_id long, status string, attempts int, updated_at timestamp, loaded_at timestamp, key string, node int"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def states(spark, rows, upto):
    df = spark.createDataFrame([(c, s, a, at(u), at(x), "k", 1) for c, s, a, u, x in rows], LOG)
    return incremental.latest_state(df, "chunk_id", ["status", "attempts"], "updated_at", "loaded_at", F.col("loaded_at") <= F.lit(at(upto)))


def changed(spark, rows, upto):
    s = states(spark, rows, upto)
    side = lambda x: s.filter(f"has_{x}").select("key", f"{x}_fields.*")
    tree = lambda x: incremental.merkle_tree(side(x), "key", ["status", "attempts"])
    return sorted(r.key for r in incremental.changed_rows(side("now"), tree("now"), side("then"), tree("then"), "key", ["status", "attempts"]).collect())


def test_changes_late_rows_repeats_and_nulls(spark):
    rows = [
        (1, "pending", 0, 1, 1),  # read, unchanged
        (2, "pending", 0, 1, 1), (2, "completed", 1, 5, 9),  # changed
        (3, "pending", 0, 6, 9),  # new
        (4, "failed", 1, 4, 1), (4, "pending", 0, 2, 9),  # an old state that came late
        (5, "pending", 0, 1, 1), (5, "pending", 0, 1, 1),  # logged twice
        (6, None, None, 1, 1), (6, None, None, 8, 9),  # null stays null
        (7, "pending", 0, None, 1), (7, "pending", 1, None, 9),  # ties of null times
        (None, "pending", 0, 1, 9),
        (10**12, "pending", 0, 1, 9), (-5, "pending", 0, 1, 1),
    ]
    assert changed(spark, rows, 4) == [2, 3, 7, 10**12]
    assert changed(spark, rows, None) == sorted({r[0] for r in rows if r[0] is not None})
    assert changed(spark, [], 4) == []


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randint(1, 500), r.choice(["pending", "failed"]), r.randint(0, 2), i, r.randint(0, 9)) for i in range(1500)]
    want = []
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        now = max(own, key=lambda x: x[3])
        then = max((x for x in own if x[4] <= 6), key=lambda x: x[3], default=None)
        if then is None or now[1:3] != then[1:3]:
            want.append(c)
    assert changed(spark, rows, 6) == sorted(want)


def test_runs(spark):
    rows = [(1, "succeeded", at(5), at(1)), (2, "succeeded", at(9), at(1)), (2, "failed", at(9), at(2)), (3, "aborted", at(20), at(3)), (4, "succeeded", None, at(3)), (1, "succeeded", at(5), at(1))]
    df = spark.createDataFrame(rows, "run_id int, outcome string, read_upto timestamp, logged_at timestamp")
    assert incremental.read_up_to(df) == at(5)
    assert incremental.read_up_to(df.limit(0)) is None


def test_store_survives_a_failed_run(spark, tmp_path):
    store = incremental.MerkleStore(spark, f"file://{tmp_path}/store")
    make = lambda d: spark.createDataFrame(sorted(d.items()), "id long, v string")
    seen = lambda df: {r.id: r.v for r in df.collect()}
    a = {i: f"v{i}" for i in range(300)}
    assert seen(store.run(make(a), "id", ["v"], lambda c: c)) == a
    b = a | {7: "new", 1000: "more", 8: None}

    def fails(c):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(make(b), "id", ["v"], fails)
    first = store.version()
    # the run dies after it has published: its output is found, and its records are not taken again
    publish = store.publish

    def dies(*args):
        publish(*args)
        raise RuntimeError("lost")

    store.publish = dies
    with pytest.raises(RuntimeError):
        store.run(make(b), "id", ["v"], lambda c: c)
    store.publish = publish
    assert seen(store.output()) == {7: "new", 8: None, 1000: "more"} and seen(store.state()) == b
    assert seen(store.run(make(b), "id", ["v"], lambda c: c)) == {}
    assert [seen(store.output(v)) for v in store.versions(first)] == [{7: "new", 8: None, 1000: "more"}, {}]
    # it dies before: the version in force stays, and the records are taken by the next run
    c = b | {9: "again"}
    note = store._write_note

    def full(name, content):
        raise OSError("disk full")

    store._write_note = full
    with pytest.raises(OSError):
        store.run(make(c), "id", ["v"], lambda x: x)
    store._write_note = note
    assert seen(store.state()) == b and seen(store.run(make(c), "id", ["v"], lambda x: x)) == {9: "again"}


def test_store_refuses_a_version_made_from_an_older_one(spark, tmp_path):
    store = incremental.MerkleStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    store.run(df, "id", ["v"], lambda c: c)
    with pytest.raises(RuntimeError):
        store.publish(df, df, df, None)


def test_only_rows_of_changed_leaves_are_read_on(spark):
    make = lambda d: spark.createDataFrame(sorted(d.items()), "id long, v string")
    a = {i: "x" for i in range(0, 100_000, 7)}
    tree = lambda d: incremental.merkle_tree(make(d), "id", ["v"])
    leaves = incremental.changed_leaves(tree(a | {700: "y"}), tree(a)).collect()
    assert [r.node for r in leaves] == [700 >> incremental.LEAF_BITS]


def test_tree_aggregate_with_a_hot_key_and_nulls(spark):
    rows = [(1 if i % 3 else (None if i % 2 else i % 11), i % 5, 0, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "source_entity_id long, target_entity_id long, n_edges int, side string").repartition(13)
    got = {(r.side, r.entity_id): r.n_edges for r in skew.edges_per_side(df).collect()}
    want = {}
    for s, t, *_ in rows:
        want["source", s] = want.get(("source", s), 0) + 1
        want["target", t] = want.get(("target", t), 0) + 1
    assert got == want
    heavy = {tuple(r) for r in skew.heavy_ends(df).collect()}
    assert heavy == {k for k, n in want.items() if k[1] is not None and n >= 0.02 * len(rows)}
    assert skew.heavy_ends(df.limit(0)).count() == 0


def test_running_total_and_ranks(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "a", i, r.randint(1, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {x.o: x.before for x in running_total(df, ["g"], [F.col("o").asc()], "w", "before").collect()}
    assert got == {o: sum(w2 for g2, o2, w2 in rows if g2 == g and o2 < o) for g, o, w in rows}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_competition_ranks(spark, parts):
    """Groups and ties that span partitions, nulls, and an own column _r."""
    r = random.Random(6)
    rows = [("a" if i % 3 else r.choice(["b", "c", None]), i, r.choice([5.0, 5.0, 5.0, 1.5, 2.5, float(i), None]), "x") for i in range(300)]
    rows += [("ties", i, 4.0, "x") for i in range(100)] + [("nulls", i, None, "x") for i in range(40)] + [("hot", i, None if i > 50 else 7.0, "x") for i in range(100)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "g string, i int, s double, more string")
    got = {(x.g, x.i): x.rank for x in competition_ranks(df, ["g"], "s", ["i"], "rank").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for g, i, s, _ in rows:
        own = [x[2] for x in rows if x[0] == g and x[2] is not None]
        mine = s if s is not None else min(own, default=0)
        want[g, i] = 1 + sum(x > mine for x in own)
    assert got == want
    assert competition_ranks(df.limit(0), ["g"], "s", ["i"], "rank").count() == 0
