"""Near-duplicate texts by anchor points of a covering code.

A text is the set of its neighbouring word pairs.  In each of TABLES tables two
minhashes of the set choose a block, and one bit each of 23 further minhashes is its
fingerprint; fingerprints of texts of similarity s differ in about
23 * (1 - s) / 2 bits.  The anchors are the 4,096 words of the perfect
binary Golay code, whose balls of radius 3 cover every fingerprint once.  A
text is at home at its one anchor within radius 3 and is replicated to every
anchor within 3 + D; if two fingerprints differ in at most D bits, the second
is replicated to the first one's home.  Per block and anchor the texts at home
are compared with those replicated; pairs are screened by a longer sketch and
verified on the texts themselves.

All anchors of a block are in one task, so replicas are made where they are
compared.  A block that holds very many texts (HOT_BLOCK) is dealt by groups of
anchors to many tasks, which finds the same pairs.

Texts with equal sets are compared once, as one class.
"""

from __future__ import annotations

import builtins
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.skew import join_classes
from skein.session import materialize, shuffle_partitions
from skein.sources.tables import table

SIMILARITY = 0.6
MIN_WORDS = 20
SHINGLE = 2
TABLES = 44
#: Minhashes that make the key of a block.
BLOCK_HASHES = 2
BITS = 23
D = 3
#: Sets of BITS minhashes, one per permutation of the hashes; tables draw theirs from all of them.
PERMUTATIONS = 16
#: Bits of the sketch that candidates are screened with, and by how many standard deviations a pair may differ in more of them than expected.
SKETCH_WORDS, SKETCH_DEVIATIONS = 4, 5
#: Fingerprints that one comparing task holds about.
TASK_ROWS = 1 << 20
#: Fingerprints of one block above which its anchors are dealt to several tasks; blocks are sized up by one class in SAMPLE.
HOT_BLOCK, SAMPLE = 1 << 16, 64
#: Fingerprints that are replicated at a time.
STEP = 1 << 17

_WORDS = re.compile(r"[^\W_]+")
_U = np.uint64


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class _Hashes(dict):
    """64-bit hash of a word, kept for the words met so far in this worker."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(ws: list[str], shingle: int, hashes: dict) -> np.ndarray:
    """Sorted hashes of the distinct runs of `shingle` words."""
    h = np.fromiter((hashes[w] for w in ws), np.uint64, len(ws))
    n = len(h) - shingle + 1
    if n <= 0:
        return h[:0]
    x = h[:n].copy()
    for k in range(1, shingle):
        x = _mix(x + _U(0x9E3779B97F4A7C15)) ^ h[k : k + n]
    return np.unique(_mix(x))


def minhash_pool(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(sets, permutations * 23) hashed minhashes: of each permutation of the hashes the least in 23 bins, empty bins filled from others of the set."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets]) * BITS
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    out = np.empty((n, permutations, BITS), np.uint64)
    column = np.arange(BITS)
    empty = np.uint32(0xFFFFFFFF)
    for g in range(permutations):
        x = _mix(h + _U((g + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((x >> _U(32)) * _U(BITS) >> _U(32)).astype(np.int64)
        low = np.full(n * BITS, empty)
        np.minimum.at(low, row + bins, (x & _U(0xFFFFFFFE)).astype(np.uint32))
        low = low.reshape(n, BITS)
        bare = low == empty
        full = low.copy()
        for k in range(1, 64):
            if not bare.any():
                break
            # where an empty bin looks at its k-th try is the same in every set
            at = (_mix((column + (k << 8) + (g << 16)).astype(np.uint64)) % _U(BITS)).astype(np.int64)
            full = np.where(bare, low[:, at], full)
            bare = full == empty
        out[:, g] = _mix(full.astype(np.uint64) + ((column + g * BITS).astype(np.uint64) << _U(40)))
    return out.reshape(n, -1)


def block_keys(sets: list[np.ndarray], tables: int) -> np.ndarray:
    """(sets, tables) keys of blocks: for each table BLOCK_HASHES least hashes of the whole set, so texts of similarity s share a block with probability s ** BLOCK_HASHES."""
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    factor = np.random.default_rng(47).integers(1, 2**63, (tables, BLOCK_HASHES), dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(sets), tables), np.uint64)
    for t in range(tables):
        key = np.full(len(sets), t, np.uint64)
        for f in factor[t]:
            key = _mix(key + np.minimum.reduceat(h * f, begin))
        out[:, t] = key
    return out


def fingerprints(pool: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(prints, sketches) of a pool: 23-bit fingerprints of each table, one bit each of 23 minhashes, and SKETCH_WORDS words of sketch."""
    r = np.random.default_rng(23)
    prints = np.empty((len(pool), tables), np.uint32)
    for t in range(tables):
        column, bit = r.choice(pool.shape[1], BITS, replace=False), r.integers(8, 56, BITS).astype(np.uint64)
        prints[:, t] = _pack(pool[:, column] >> bit & _U(1))
    first = pool[:, np.arange(64 * SKETCH_WORDS) % pool.shape[1]] & _U(1)
    return prints, np.stack([_pack(first[:, k * 64 : k * 64 + 64]) for k in range(SKETCH_WORDS)], axis=1)


def sketch_limit(similarity: float) -> int:
    """Bits in which the sketches of two texts of a similarity may differ."""
    n, p = 64 * SKETCH_WORDS, (1 - similarity) / 2
    return int(np.ceil(n * p + SKETCH_DEVIATIONS * np.sqrt(n * p * (1 - p))))


class Golay:
    """The perfect binary Golay code of length 23: 12 message bits, covering radius 3."""

    GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self, threshold: int):
        units = []
        for i in range(BITS):
            w = 1 << i
            for j in range(BITS - 1, 10, -1):
                if w >> j & 1:
                    w ^= self.GENERATOR << (j - 11)
            units.append(w)
        self.parts = []
        for byte in range(3):
            t = np.zeros(256, np.uint32)
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and byte * 8 + i < BITS:
                        t[v] ^= units[byte * 8 + i]
            self.parts.append(t)
        patterns, weights = [], []
        for w in range(3 + threshold + 1):
            for bits in itertools.combinations(range(BITS), w):
                patterns.append(sum(1 << b for b in bits))
                weights.append(w)
        patterns = np.array(patterns, np.uint32)
        syndrome = self.syndrome(patterns)
        order = np.argsort(syndrome, kind="stable")  # by syndrome, then by weight
        self.patterns = patterns[order]
        self.first = np.searchsorted(syndrome[order], np.arange(2049))
        self.leader = self.patterns[self.first[:-1]]
        assert np.array(weights)[order][self.first[:-1]].max() == 3

    def syndrome(self, w: np.ndarray) -> np.ndarray:
        return self.parts[0][w & 255] ^ self.parts[1][w >> 8 & 255] ^ self.parts[2][w >> 16]

    def home(self, w: np.ndarray) -> np.ndarray:
        """Number of the one anchor within radius 3."""
        return (w ^ self.leader[self.syndrome(w)]) >> 11

    def near(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in w, anchors): every anchor within 3 + threshold of each word."""
        s = self.syndrome(w)
        count = (self.first[1:] - self.first[:-1])[s]
        row = np.repeat(np.arange(len(w), dtype=np.int32), count)
        begin = np.cumsum(count) - count
        at = np.arange(len(row)) - np.repeat(begin - self.first[s], count)
        return row, ((w[row] ^ self.patterns[at]) >> 11).astype(np.uint16)


def _golay(threshold: int) -> Golay:
    cache = builtins.__dict__.setdefault("_skein_cache", {})
    if ("golay", threshold) not in cache:
        cache["golay", threshold] = Golay(threshold)
    return cache["golay", threshold]


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of at most 64 bits as numbers."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_SKETCH = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))


def _sketch(min_words: int, shingle: int, permutations: int, tables: int):
    """Of each text that is long enough two sums that stand for its set, the sketch, and the tables' blocks and fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = builtins.__dict__.setdefault("_skein_cache", {}).setdefault("words", _Hashes())
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                ids, sets = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    ws = words(t.as_py())
                    if len(ws) >= max(min_words, shingle):
                        ids.append(i)
                        sets.append(shingle_hashes(ws, shingle, hashes))
                if not ids:
                    continue
                keys = block_keys(sets, tables)
                prints, sketch = fingerprints(minhash_pool(sets, permutations), tables)
                h0 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                h1 = np.array([_mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                lists = [[r.tobytes() for r in x] for x in (keys, prints)]
                cols = [pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (h0, h1, *sketch.T)), *(pa.array(x, pa.binary()) for x in lists)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h0", "h1", *(f"s{k}" for k in range(SKETCH_WORDS)), "keys", "prints"])

    return run


def _table_arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, keys, prints) of a (rep, keys, prints) batch."""
    n = b.num_rows
    read = lambda c, kind: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(n, -1)
    return b.column(0).to_numpy(), read(b.column(1), np.uint64), read(b.column(2), np.uint32)


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_table_arrays(b)[1].ravel().view(np.int64))], names=["key"])


#: A fingerprint on its way: 40 bits of its block's key (the task has the rest), whether the text is at home there, 23 bits of print; and the class.
_ENTRY = np.dtype([("word", np.uint64), ("rep", np.int64)])


def _deal(tasks: int, hot, threshold: int):
    """(task, entries): the fingerprints, packed per task; those of hot blocks once per group of anchors in which they are at home or replicated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_hot, groups_hot = hot.value
        for whole in batches:
            for start in range(0, whole.num_rows, 8000):
                b = whole.slice(start, 8000)
                if not b.num_rows:
                    continue
                rep, keys, prints = _table_arrays(b)
                row = np.repeat(np.arange(len(rep)), keys.shape[1])
                key, prnt, home = keys.ravel(), prints.ravel(), np.ones(keys.size, bool)
                if len(keys_hot):
                    at = np.minimum(np.searchsorted(keys_hot, key), len(keys_hot) - 1)
                    is_hot = keys_hot[at] == key
                    h = np.flatnonzero(is_hot)
                    golay = _golay(threshold)
                    of, anchor = golay.near(prnt[h])  # the home anchor is among them
                    width = groups_hot[at[h]].astype(np.int64)
                    both = np.unique(of.astype(np.int64) << 12 | anchor % width[of])
                    of, group = both >> 12, both & 4095
                    at_home = golay.home(prnt[h])[of] % width[of] == group
                    rest = np.flatnonzero(~is_hot)
                    row = np.concatenate([row[rest], row[h[of]]])
                    key = np.concatenate([key[rest], _mix(key[h[of]] + (group + 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))])
                    prnt = np.concatenate([prnt[rest], prnt[h[of]]])
                    home = np.concatenate([np.ones(len(rest), bool), at_home])
                task = ((key >> _U(40)) % _U(tasks)).astype(np.int64)
                out = np.empty(len(key), _ENTRY)
                out["word"] = (key & _U(0xFFFFFFFFFF)) << _U(24) | home.astype(np.uint64) << _U(23) | prnt
                out["rep"] = rep[row]
                order = np.argsort(task, kind="stable")
                own, begin = np.unique(task[order], return_index=True)
                out = out[order]
                parts = [x.tobytes() for x in np.split(out, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(parts, pa.binary())], names=["task", "entries"])

    return run


def compare(entries: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes (smaller id first) of one block whose fingerprints differ in at most `threshold` bits, found per anchor: each text at home meets those replicated to its anchor."""
    golay = _golay(threshold)
    block = entries["word"] >> _U(24)
    order = np.argsort(block, kind="stable")
    entries, block = entries[order], block[order]
    new = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.empty(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(block)))
    many = np.repeat(size > 1, size)
    entries, number = entries[many], (np.cumsum(new) - 1)[many]
    lows, highs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.flatnonzero(np.append(number[1:] != number[:-1], True)) + 1 if len(number) else np.empty(0, np.int64)
    a = 0
    while a < len(entries):
        z = int(ends[max(np.searchsorted(ends, a + STEP, "right") - 1, np.searchsorted(ends, a, "right"))])  # whole blocks
        rep = entries["rep"][a:z]
        prints = (entries["word"][a:z] & _U(0x7FFFFF)).astype(np.uint32)
        at_home = np.flatnonzero(entries["word"][a:z] >> _U(23) & _U(1))
        place = (number[a:z] - number[a]) << 12
        home = place[at_home] | golay.home(prints[at_home]).astype(np.int64)
        by = np.argsort(home, kind="stable")
        home, at_home = home[by], at_home[by]
        taken = np.zeros(1 << 22, bool)
        slot = lambda x: (x * 0x9E3779B1 >> 9) & ((1 << 22) - 1)
        taken[slot(home)] = True
        for low in range(0, z - a, STEP):
            row, anchor = golay.near(prints[low : low + STEP])
            row = row + low
            met = place[row] | anchor
            some = taken[slot(met)]
            row, met = row[some], met[some]
            begin = np.searchsorted(home, met, "left")
            count = np.searchsorted(home, met, "right") - begin
            done = 0
            while done < len(row):  # about 4 M pairs at a time
                until = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), 1 << 22, "right")) + done)
                c = count[done:until]
                j = np.repeat(row[done:until], c)
                i = at_home[np.arange(len(j)) - np.repeat(np.cumsum(c) - c - begin[done:until], c)]
                fine = (rep[i] < rep[j]) & (np.bitwise_count(prints[i] ^ prints[j]) <= threshold)  # each pair at the home of its smaller id
                lows.append(rep[i[fine]])
                highs.append(rep[j[fine]])
                done = until
        a = z
    return np.concatenate(lows), np.concatenate(highs)


def _compare(threshold: int):
    """Pairs of a partition, which holds the entries of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.as_py() for b in batches for x in b.column(0)]
        if parts:
            a, b = compare(np.frombuffer(b"".join(parts), _ENTRY), threshold)
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _verify(similarity: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(t):
            w = words(t)
            return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}

        for b in batches:
            a_out, b_out, s_out = [], [], []
            for a, c, x, y in zip(*(col.to_pylist() for col in b.columns)):
                x, y = runs(x), runs(y)
                both = len(x & y)
                s = both / (len(x) + len(y) - both)
                if s >= similarity:
                    a_out.append(a), b_out.append(c), s_out.append(s)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64()), "similarity": pa.array(s_out, pa.float64())})

    return run


def _hot_blocks(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, groups) of blocks with more than about HOT_BLOCK texts, by a sample of the classes, and into how many groups their anchors are dealt.

    Only how the work is dealt depends on it.  At most one block in HOT_BLOCK
    fingerprints can be among them; if they were over a million, only larger
    ones would be dealt.
    """
    part = classes.filter(F.pmod(F.xxhash64(F.lit(9), "rep"), F.lit(SAMPLE)) == 0).select("rep", "keys", "prints")
    n = part.mapInArrow(_sample_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * SAMPLE > HOT_BLOCK)
    got = n.orderBy(F.desc("n"), "key").limit(1_000_000).toArrow()
    keys, size = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy() * SAMPLE
    order = np.argsort(keys)
    # a text is replicated to some 71 of the 4,096 anchors
    groups = 2 ** np.ceil(np.log2(np.clip(71 * size / HOT_BLOCK, 2, 4096))).astype(np.int64)
    return keys[order], groups[order]


def near_duplicate_classes(texts: DataFrame, key: str, text: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, shingle: int = SHINGLE, tables: int = TABLES, threshold: int = D) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class_id) puts texts with equal sets into one class, named after its smallest id; links (a, b, similarity) joins classes.

    Null, blank and short texts (fewer than min_words words) take no part.
    Rows with a null id are dropped, repeated rows count once; an id must
    stand for one text.  No class, however large, is expanded.  Every text is
    read whole.
    """
    spark = texts.sparkSession
    src = texts.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = materialize(src.mapInArrow(_sketch(min_words, shingle, PERMUTATIONS, tables), f"id long, h0 long, h1 long, {_SKETCH}, keys binary, prints binary"))
    ids = sketched.select("id", "h0", "h1").distinct()
    sets = materialize(ids.groupBy("h0", "h1").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")))
    members = materialize(join_classes(ids, sets, ["h0", "h1"]).select("id", "class_id"))
    copies = materialize(members.filter("id != class_id").select("id"))
    classes = sketched.join(copies, "id", "left_anti").withColumnRenamed("id", "rep")
    n = sets.count()
    hot = spark.sparkContext.broadcast(_hot_blocks(classes))
    tasks = max(shuffle_partitions(spark), -(-n * tables // TASK_ROWS))
    dealt = classes.select("rep", "keys", "prints").mapInArrow(_deal(tasks, hot, threshold), "task long, entries binary")
    pairs = dealt.repartitionById(tasks, F.col("task").cast("int")).select("entries").mapInArrow(_compare(threshold), "a long, b long").distinct()
    side = lambda c, p: classes.select(F.col("rep").alias(c), *[F.col(f"s{k}").alias(f"{p}{k}") for k in range(SKETCH_WORDS)])
    differ = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    pairs = materialize(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(differ <= sketch_limit(similarity)).select("a", "b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts_ = materialize(src.join(wanted, "id", "left_semi"))
    both = pairs.join(texts_.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts_.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verify(similarity, shingle), "a long, b long, similarity double")
    return members, links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b): the links of classes, and the classes themselves, as pairs of rows; only for results that are defined as pairs."""
    members, links = materialize(members), materialize(links.select("a", "b"))
    m = lambda side: members.select(F.col("class_id").alias(side), F.col("id").alias(f"id_{side}"))
    across = links.join(m("a"), "a").join(m("b"), "b").select("id_a", "id_b")
    inside = m("a").withColumnRenamed("a", "c").join(m("b").withColumnRenamed("b", "c"), "c").filter("id_a < id_b").select("id_a", "id_b")
    pairs = across.unionAll(inside)
    return pairs.filter("id_a != id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): chunks whose sets of neighbouring word pairs have 0.6 of their union in common."""
    return row_pairs(*near_duplicate_classes(table(spark, d, "chunks"), "id", "content"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, class_id, n_links): one row per chunk with its class and the number of classes that are nearly the same."""
    members, links = near_duplicate_classes(table(spark, d, "chunks"), "id", "content")
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "class_id", "left").select(F.col("id").alias("chunk_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}

_SETS = f"""w AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS ws FROM chunks WHERE id IS NOT NULL),
    s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS b FROM w WHERE len(ws) >= {MIN_WORDS})"""
_PAIRS = "SELECT x.id AS id_a, y.id AS id_b, x.n + y.n AS n, count(*) AS m FROM u x JOIN u y ON x.g = y.g AND x.id < y.id GROUP BY ALL"

SQL = {
    "p7_found": f"WITH {_SETS}, u AS (SELECT id, len(b) AS n, unnest(b) AS g FROM s), p AS ({_PAIRS}) SELECT id_a, id_b FROM p WHERE m / (n - m)::DOUBLE >= {SIMILARITY}",
    "p7_classes": f"""WITH {_SETS}, c AS (SELECT id, b, min(id) OVER (PARTITION BY b) AS class_id FROM s), u AS (SELECT id, len(b) AS n, unnest(b) AS g FROM c WHERE id = class_id), p AS ({_PAIRS}),
        l AS (SELECT unnest([id_a, id_b]) AS class_id FROM p WHERE m / (n - m)::DOUBLE >= {SIMILARITY}), k AS (SELECT class_id, count(*) AS n FROM l GROUP BY class_id)
        SELECT c.id AS chunk_id, c.class_id, coalesce(k.n, 0) AS n_links FROM c LEFT JOIN k USING (class_id)""",
}
