"""Nearest neighbours of vectors by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords: one or two of
coarse codebooks, whose numbers are also the vector's list, and one of each of
BOOKS codebooks of 256 trained on what the ones before leave over.  The codes
come from a beam search.  A query's inner products with all codewords form
a look-up table; the sum of a row's table entries, scaled by a stored norm,
estimates the cosine.  What passes is screened by the signs of both vectors'
differences from the list's codeword, and the rest is ranked anew with the
exact vectors.

Codewords can't order what lies close around them, so vectors near a codeword
of a dense list are compared with all that can be similar to them, by exact
products.

Vectors that are equal number by number are searched once, as one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.skew import join_classes
from skein.session import materialize
from skein.sources.tables import table

DIM = 384
K = 5
#: Codebooks are fitted on about this many vectors, chosen by a hash of their ids; every vector is indexed.
TRAIN = 16_384
#: Vectors of the sample for each word of the first coarse codebook, at least; what lists are wanted beyond comes from the second one.
PER_WORD = 8
BOOKS, WORDS, BEAM = 7, 256, 4
#: Lists in which each row is entered; a query looks into the one it is nearest to.
ENTRIES = 4
#: How far below the wanted similarity an estimate may lie.
MARGIN = 0.15
#: A list is dense if its vectors lie about this near to its codeword; dense lists with codewords within MERGED of another's form a group.
DENSE, MERGED = 0.5, 0.75
#: More than two float32 products of unit vectors of DIM numbers can be wrong by together.
ERROR = 5e-5
#: Queries and rows that one tile holds; larger lists are split into tiles.
TILE = 8_192
#: Products of vectors with words that training holds at once; all of a sample's would be hundreds of MB where there are many lists.
PART = 1 << 22
#: Share of the lists that a query for its nearest rows asks, and rows of one tile then; a query goes to many tiles, so they are larger.
PROBE, KNN_TILE = 0.125, 32_768


@dataclass
class Books:
    """The codebooks.  A list's codeword is the sum of one of top and one of sub, so a bounded sample gives any number of lists."""

    top: np.ndarray
    sub: np.ndarray  # a single zero while top has enough words
    fine: np.ndarray  # BOOKS * WORDS x dim
    gram: np.ndarray  # of fine with fine
    blocks: np.ndarray  # tiles' width of each list, then of each dense group, for about TILE rows or queries each
    dense: np.ndarray  # the dense lists, group by group
    begin: np.ndarray  # where each group begins there
    group: np.ndarray  # of each list, or -1

    def __post_init__(self):
        self.lists = len(self.top) * len(self.sub)
        self.half = self.fit(np.zeros((1, self.top.shape[1]), np.float32))[0] * -1  # half the codewords' squared lengths

    def plain(self) -> tuple[np.ndarray, ...]:
        """What a worker without this package can read, and open with Books(*plain)."""
        return self.top, self.sub, self.fine, self.gram, self.blocks, self.dense, self.begin, self.group

    def word(self, lists: np.ndarray) -> np.ndarray:
        return self.top[lists // len(self.sub)] + self.sub[lists % len(self.sub)]

    @property
    def coarse(self) -> np.ndarray:
        return self.word(np.arange(self.lists))

    def fit(self, x: np.ndarray) -> np.ndarray:
        """(vectors, lists): product with the list's codeword, less half its squared length."""
        parts = [x @ w.T - 0.5 * (w * w).sum(1) for w in (self.top, self.sub)]
        return (parts[0][:, :, None] + (parts[1][:, None, :] - self.top @ self.sub.T)).reshape(len(x), self.lists)

    def cross(self, lists: np.ndarray) -> np.ndarray:
        """Products of codewords with fine words."""
        if not hasattr(self, "_cross"):
            self._cross = self.top @ self.fine.T, self.sub @ self.fine.T
        return self._cross[0][lists // len(self.sub)] + self._cross[1][lists % len(self.sub)]


def _parts(n: int, words: int) -> Iterator[slice]:
    """Slices of n vectors, of about PART products with so many words each."""
    step = max(64, PART // words)
    return (slice(k, k + step) for k in range(0, n, step))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the word of c that each vector is nearest to."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[s] @ c.T - half, axis=1) for s in _parts(len(x), len(c))])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], begin[full], axis=0) / n[full, None]
        if (~full).any():
            c[~full] = x[r.integers(len(x), size=(~full).sum())]
    return c


def _dense_groups(books: Books, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense, begin, group) of Books; a codeword's length tells how near the unit vectors that it is the mean of are."""
    group = np.full(books.lists, -1)
    # lists that no vector of the sample is at home in are no means of any
    dense = np.flatnonzero((2 * books.half >= 1 - DENSE**2) & (share > 0))
    dense = dense[np.argsort(-share[dense], kind="stable")]
    groups = 0
    for c in dense:
        if group[c] < 0:
            free = dense[group[dense] < 0]
            group[free[((books.word(free) - books.word(c)) ** 2).sum(1) <= MERGED**2]] = groups
            groups += 1
    dense = dense[np.argsort(group[dense], kind="stable")]
    return dense, np.searchsorted(group[dense], np.arange(groups)), group


def in_dense(fit: np.ndarray, home: np.ndarray, books: Books, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(own, meets) of unit vectors: the dense group of those within DENSE of their codeword, else -1, and by group whether a vector can be similar to such a one.

    If a vector's cosine with one within DENSE of a codeword is at least
    `least`, its own distance from that codeword is at most DENSE and the chord.
    """
    if not len(books.dense):
        return np.full(len(fit), -1), np.zeros((len(fit), 0), bool)
    least_fit = lambda far: (1 - far * far) / 2
    own = np.where(fit[np.arange(len(fit)), home] >= least_fit(DENSE), books.group[home], -1)
    near = fit[:, books.dense] >= least_fit(DENSE + math.sqrt(max(0.0, 2 - 2 * least))) - ERROR
    return own, np.logical_or.reduceat(near, books.begin, axis=1)


def train(sample: np.ndarray, lists: int, n: int, seed: int = 7, least: float = 0.85) -> Books:
    """Codebooks of unit vectors: top, with a word for every PER_WORD vectors at most, sub on its residuals if more lists are wanted, then one after another on what is left."""
    words = max(1, min(lists, len(sample) // PER_WORD))
    top = _kmeans(sample, words, 6, seed).astype(np.float32)
    sub = np.zeros((1, sample.shape[1]), np.float32)
    if lists > words:
        sub = _kmeans(sample - top[_nearest(sample, top)], -(-lists // words), 6, seed).astype(np.float32)
    none = np.zeros(0, np.int64)
    books = Books(top, sub, np.zeros((BOOKS * WORDS, sample.shape[1]), np.float32), none, none, none, none, none)
    home = np.concatenate([np.argmax(books.fit(sample[s]), axis=1) for s in _parts(len(sample), books.lists)])
    left = sample - books.word(home)
    fine = []
    for m in range(BOOKS):
        c = _kmeans(left, WORDS, 5, seed + m + 1)
        if len(c) < WORDS:
            c = np.concatenate([c, np.zeros((WORDS - len(c), c.shape[1]), c.dtype)])
        left = left - c[_nearest(left, c)]
        fine.append(c)
    books.fine = np.concatenate(fine).astype(np.float32)
    books.gram = books.fine @ books.fine.T
    share = books.share = np.bincount(home, minlength=books.lists) / max(1, len(sample))
    books.dense, books.begin, books.group = _dense_groups(books, share)
    meets = np.zeros(len(books.begin))
    if len(books.begin):
        once = np.array(sorted({r.tobytes(): i for i, r in enumerate(sample)}.values()))  # equal vectors meet once
        for s in _parts(len(once), books.lists):
            meets += in_dense(books.fit(sample[once[s]]), home[once[s]], books, least)[1].sum(axis=0)
    books.blocks = np.maximum(1, np.ceil(np.concatenate([share, meets / max(1, len(sample))]) * n / TILE)).astype(np.int32)
    return books


def beam_codes(x: np.ndarray, home: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scale): the beam search's best codes of x - coarse[home], and what makes their product with a query an estimate without bias."""
    n = len(x)
    dots = x @ books.fine.T - books.cross(home)  # of the residual
    half = 0.5 * (books.fine * books.fine).sum(1)
    score = np.zeros((n, 1), np.float32)
    used = np.zeros((n, 1, BOOKS * WORDS), np.float32)
    codes = np.zeros((n, 1, 0), np.int64)
    rows = np.arange(n)[:, None]
    for m in range(BOOKS):
        s = slice(m * WORDS, (m + 1) * WORDS)
        gain = score[:, :, None] + (dots[:, None, s] - half[s] - used[:, :, : WORDS])
        flat = gain.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        top = np.argpartition(-flat, keep - 1, axis=1)[:, :keep]
        score = flat[rows, top]
        parent, word = top // WORDS, top % WORDS
        codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
        if m + 1 < BOOKS:
            used = used[rows, parent][:, :, WORDS:] + books.gram[m * WORDS + word][:, :, (m + 1) * WORDS :]
    best = np.argmax(score, axis=1)
    codes = codes[np.arange(n), best]
    own = dots[np.arange(n)[:, None], codes + np.arange(BOOKS) * WORDS].sum(1)  # residual . its approximation
    rest = 1.0 - 2 * (x * books.word(home)).sum(1) + 2 * books.half[home]  # |residual|^2
    scale = np.where(own > 1e-6, rest / np.maximum(own, 1e-6), 0.0)
    return codes.astype(np.uint8), np.clip(scale, 0.0, 50.0).astype(np.float32)


def estimate(q: np.ndarray, home: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: Books) -> np.ndarray:
    """Estimated cosines of unit queries with coded rows, from look-up tables."""
    lut = q @ books.fine.T
    out = np.zeros((len(q), len(codes)), np.float32)
    for m in range(BOOKS):
        out += np.take(lut[:, m * WORDS : (m + 1) * WORDS], codes[:, m], axis=1)
    out *= scale
    lists, at = np.unique(home, return_inverse=True)
    out += np.take(q @ books.word(lists).T, at, axis=1)
    return out


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, hashes) of an (id, v) batch's rows whose numbers are all there, finite and not all zero; two hashes of a vector's bytes."""
    import xxhash

    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(batch.num_rows, -1)
    norm = np.einsum("ij,ij->i", x.astype(np.float64), x)
    good = np.isfinite(norm) & (norm > 0)
    x, ids = np.ascontiguousarray(x[good]), batch.column(0).to_numpy()[good]
    raw = [xxhash.xxh3_128_digest(r.data) for r in x]
    return ids, x, np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x))[:, None]).astype(np.float32)


def _unit64(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float32).reshape(len(data), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ids, _, h = _usable(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "h0", "h1"])


_ROW = pa.schema([("tile", pa.int64()), ("query", pa.bool_()), ("id", pa.int64()), ("h0", pa.int64()), ("home", pa.int32()), ("list", pa.int32()), ("data", pa.binary())])
_ROW_SQL = "tile long, query boolean, id long, h0 long, home int, list int, data binary"


def _signs(x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, squared length) of the differences from base."""
    r = x - base
    return np.packbits(r > 0, axis=1), np.einsum("ij,ij->i", r, r)


def _best(q: np.ndarray, x: np.ndarray, k: int, same: np.ndarray, least: float = -2.0, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): for each of the unit vectors q the k best of x with at least `least`, and what equals the last in so many digits.

    same holds the key of each of q and x; equal ones don't meet.  float32
    products leave out what is lower by more than their error, float64 decides.
    """
    qk, xk = same[: len(q)], same[len(q) :]
    x32, out = x.astype(np.float32), []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        e = part.astype(np.float32) @ x32.T
        e[qk[at : at + 256, None] == xk] = -9
        low = np.partition(e, -k, axis=1)[:, -k] if e.shape[1] > k else np.full(len(e), -2, np.float32)
        i, j = np.nonzero((e >= np.maximum(low, least)[:, None] - ERROR) & (e > -3))
        v = (part @ x.T)[i, j] if len(i) > e.size // 64 else np.einsum("ij,ij->i", part[i], x[j])
        shown = np.round(v, digits)
        order = np.lexsort((-shown, i))
        i, j, v, shown = i[order], j[order], v[order], shown[order]
        last = np.searchsorted(i, i, "left") + k - 1
        ends = np.minimum(last, len(i) - 1)
        fine = (v >= least - 1e-9) & ((last >= len(i)) | (i[ends] != i) | (shown >= shown[ends]))
        out.append((at + i[fine], j[fine], v[fine]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _enter(sent, entries: int, least: float):
    """Each vector as a query in its own list, with itself in half precision, and in its nearest lists as a coded row.

    One within DENSE of the codeword of a dense list is a query of that list's
    group instead; whatever can be similar to such ones is a row there, in
    full, and asks for them in turn if it is no query there or elsewhere (home -1).
    A list is cut into tiles of blocks of queries by blocks of rows: a query
    goes to the tiles of its block, a row to those of its own.
    """

    def rows(lists, query, ids, h, home, data, books):
        width = books.blocks[lists]
        own = (h[:, 1].astype(np.uint64) % width.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(ids)), width)
        other = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
        q, x = (own[at], other) if query else (other, own[at])
        tile = lists[at].astype(np.int64) << 40 | q << 20 | x
        return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(np.full(len(at), query)), pa.array(ids[at]), pa.array(h[at, 0]), pa.array(home[at].astype(np.int32)), pa.array(lists[at].astype(np.int32)), pa.array([data[i] for i in at], pa.binary())], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(*sent.value)
        near = min(entries, books.lists)
        step = max(64, min(1000, (1 << 22) // books.lists))
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                ids, x, h = _usable(whole.slice(start, step))
                new = []
                for i, k in enumerate(h[:, 0].tolist()):  # equal vectors once per task
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                if not new:
                    continue
                ids, raw, h = ids[new], x[new], h[new]
                x = _unit(raw)
                fit = books.fit(x)
                home = np.argmax(fit, axis=1)
                own, meets = in_dense(fit, home, books, least)
                at = np.flatnonzero(own >= 0)
                if len(at):
                    yield rows(books.lists + own[at], True, ids[at], h[at], home[at], [raw[i].tobytes() for i in at], books)
                at, groups = np.nonzero(meets)
                if len(at):
                    yield rows(books.lists + groups, False, ids[at], h[at], np.where(own[at] < 0, -1, home[at]), [raw[i].tobytes() for i in at], books)
                rest = np.flatnonzero(own < 0)
                if not len(rest):
                    continue
                ids, x, h, fit, home = ids[rest], x[rest], h[rest], fit[rest], home[rest]
                top = np.argpartition(-fit, near - 1, axis=1)[:, :near].astype(np.int64)
                codes, scale = beam_codes(x, home, books)
                yield rows(home, True, ids, h, home, [r.tobytes() for r in x.astype(np.float16)], books)
                row = np.repeat(np.arange(len(x)), near)
                lists = top.ravel()
                signs, length = _signs(x[row], books.word(lists))
                blob = np.concatenate([codes[row], scale[row, None].view(np.uint8), length.astype(np.float32)[:, None].view(np.uint8), signs], axis=1)
                yield rows(lists, False, ids[row], h[row], home[row], [r.tobytes() for r in blob], books)

    return run


def _search(sent, least: float, k: int):
    """Candidates of the queries of a tile among its rows; tiles come sorted, so one is held at a time.

    A tile of a dense group gives the k best, with their cosines (s).  In other
    tiles all that passes the estimates and signs goes on, but for pairs whose
    cosine is known here and surely below the query's k-th best.
    """
    names = ["q", "x", "s"]

    def dense(qs: list[tuple], xs: list[tuple]) -> pa.RecordBatch:
        q, x = (_unit64([r[5] for r in part]) for part in (qs, xs))
        (qid, qh), (xid, xh) = (np.array([r[1:3] for r in part]).T for part in (qs, xs))
        i, j, s = _best(q, x, k, np.concatenate([qh, xh]), least)
        a, b, c = [qid[i]], [xid[j]], [s]
        asks = np.flatnonzero([r[3] < 0 for r in xs])
        if len(asks):
            i, j, s = _best(x[asks], q, k, np.concatenate([xh[asks], qh]), least)
            a.append(xid[asks[i]]), b.append(qid[j]), c.append(s)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(m)) for m in (a, b, c)], names=names)

    def tile(books: Books, rows: list[tuple]) -> pa.RecordBatch | None:
        qs = {r[2]: r for r in rows if r[0]}  # equal vectors from several tasks once
        xs = {r[2]: r for r in rows if not r[0]}
        if not qs or not xs:
            return None
        if rows[0][4] >= books.lists:
            return dense(list(qs.values()), list(xs.values()))
        qid, xid = (np.array([r[1] for r in d.values()]) for d in (qs, xs))
        qh, xh = (np.array([r[2] for r in d.values()]) for d in (qs, xs))
        q = np.frombuffer(b"".join(r[5] for r in qs.values()), np.float16).reshape(len(qs), -1).astype(np.float32)
        blob = np.frombuffer(b"".join(r[5] for r in xs.values()), np.uint8).reshape(len(xs), -1)
        codes, (scale, length) = blob[:, :BOOKS], blob[:, BOOKS : BOOKS + 8].copy().view(np.float32).T
        home = np.array([r[3] for r in xs.values()])
        base = books.word(rows[0][4])
        q_signs, q_length = _signs(q, base)
        pack = lambda m: np.pad(m, ((0, 0), (0, -m.shape[1] % 8))).view(np.uint64)
        q_signs, x_signs = pack(q_signs), pack(np.ascontiguousarray(blob[:, BOOKS + 8 :]))
        place = {h: i for i, h in enumerate(qs)}
        same = np.array([place.get(h, -1) for h in xs])  # rows that are at home here too, as vectors
        dim = q.shape[1]
        a, b = [], []
        step = max(1, (1 << 21) // len(xs))
        for start in range(0, len(qs), step):
            e = estimate(q[start : start + step], home, codes, scale, books)
            i, j = np.nonzero(e >= least - MARGIN)
            v = e[i, j]
            i = i + start
            fine = qh[i] != xh[j]
            i, j, v = i[fine], j[fine], v[fine]
            # |q - x|^2 is at most 2 - 2 least; how many signs may differ then, with 4.5 deviations to spare
            lq, lx = q_length[i], length[j]
            c = (lq + lx - (2 - 2 * least)) / np.maximum(2 * np.sqrt(lq * lx), 1e-9)
            most = dim * np.arccos(np.clip(c, -1, 1)) / np.pi + 2.25 * math.sqrt(dim)
            fine = np.bitwise_count(q_signs[i] ^ x_signs[j]).sum(axis=1) <= most
            i, j, v = i[fine], j[fine], v[fine]
            known = same[j] >= 0
            v[known] = np.einsum("ij,ij->i", q[i[known]], q[same[j[known]]])
            fine = v >= np.where(known, least - 0.002, least - MARGIN)
            i, j, v, known = i[fine], j[fine], v[fine], known[fine]
            ki, kv = i[known], v[known]
            order = np.lexsort((-kv, ki))
            ki, kv = ki[order], kv[order]
            last = np.arange(len(ki)) - np.searchsorted(ki, ki, "left") == k - 1
            low = np.full(len(qs), -2.0)
            low[ki[last]] = kv[last]
            fine = ~known | (v >= low[i] - 0.0025)  # more than half precision can be wrong by
            a.append(qid[i[fine]]), b.append(xid[j[fine]])
        a, b = (np.concatenate(c).astype(np.int64) for c in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, key, rows = None, None, []
        for b in batches:
            books = books or Books(*sent.value)
            for at, *r in zip(*(c.to_pylist() for c in b.columns)):
                if at != key:
                    if rows and (out := tile(books, rows)) is not None:
                        yield out
                    key, rows = at, []
                rows.append(tuple(r))
        if rows and (out := tile(books, rows)) is not None:
            yield out

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            b = whole.slice(start, 2000)
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64) for i in (2, 3))
            s = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["a", "b", "similarity"])


def _sift(rows: DataFrame, wanted: DataFrame, log2_bits: int = 26) -> DataFrame:
    """Rows without most of those whose id is not wanted, by a Bloom filter of fixed size (8 MB), so that a join needn't shuffle every vector.

    The filter is or-ed together by words of 64 bits; the more ids, the more
    rows pass it, and none that is wanted is lost.
    """
    spark = rows.sparkSession
    bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << log2_bits)) for seed in (3, 5)]))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    table_ = np.zeros(1 << (log2_bits - 6), np.uint64)
    table_[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(table_)
    mask = F.array(*[F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << log2_bits)) for seed in (3, 5)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                hit = (sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)
                yield b.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return rows.select("id", "v", mask.alias("m")).mapInArrow(run, "id long, v array<float>")


def usable(vectors: DataFrame, key: str, vector: str, dim: int = DIM, *more: str) -> DataFrame:
    """(id, v): rows with an id and a vector of dim numbers; those with nulls, NaN or infinities or only zeros are left out where vectors are read."""
    v = F.col(vector)
    return vectors.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dim)).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v"), *more)


def fit(rows: DataFrame, n: int, seed: int = 7, sample: int = TRAIN, least: float = 0.85) -> Books:
    """Codebooks from about `sample` rows; the number of lists grows as the root of n."""
    part = rows if n <= sample else rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = [_unit(_usable(b)[1]) for b in part.select("id", "v").toArrow().to_batches() if b.num_rows]
    x = np.concatenate(got) if sum(map(len, got)) else np.eye(1, DIM, dtype=np.float32)
    lists = 1 << max(0, round(math.log2(2 * math.sqrt(max(1, n)))))
    return train(x, lists if len(x) >= 8 else 1, n, least=least)


def neighbour_classes(rows: DataFrame, least: float, entries: int = ENTRIES, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(members, links) of `usable` rows: members (id, class_id, size, position), links (a, b, similarity) both ways, between classes of at least that exact cosine.

    position counts the members of a class by id from 1 to K + 1; further
    members have none.  A class of any size takes part once in the search.
    """
    spark = rows.sparkSession
    hashed = materialize(rows.mapInArrow(_hash, "id long, h0 long, h1 long").distinct())  # repeated rows once
    classes = materialize(hashed.groupBy("h0", "h1").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")))
    first = hashed.withColumn("position", F.row_number().over(Window.partitionBy("h0", "h1").orderBy("id"))).filter(F.col("position") <= K + 1).select("id", "position")
    members = materialize(join_classes(hashed, classes, ["h0", "h1"]).select("id", "class_id", "size").join(first, "id", "left"))
    sent = spark.sparkContext.broadcast(fit(rows, members.count(), least=least).plain())
    entered = rows.mapInArrow(_enter(sent, entries, least), _ROW_SQL)
    found = materialize(entered.repartition("tile").sortWithinPartitions("tile").mapInArrow(_search(sent, least, k), "q long, x long, s double"))
    cls = members.select(F.col("id"), "class_id")
    pairs = found.join(cls.select(F.col("id").alias("q"), F.col("class_id").alias("a")), "q").join(cls.select(F.col("id").alias("x"), F.col("class_id").alias("b")), "x")
    pairs = pairs.filter("a != b")
    sure = pairs.filter("s IS NOT NULL").groupBy("a", "b").agg(F.max("s").alias("similarity"))
    sure = sure.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.round("similarity", 9).desc()))).filter(F.col("r") <= k)
    sides = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.filter("s IS NULL").select(*sides).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    exact = materialize(_sift(rows, wanted).join(wanted, "id", "left_semi"))
    both = pairs.join(exact.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(exact.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    half = both.select("a", "b", "va", "vb").mapInArrow(_exact, "a long, b long, similarity double").unionAll(sure.select(*sides, "similarity"))
    half = materialize(half.filter(F.col("similarity") >= least).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    links = half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return members, links


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, k: int = K, dim: int = DIM) -> DataFrame:
    """(id_a, id_b): rows of cosine >= least, one of which is among the k most similar of the other.

    Equal similarities are ordered by id.  Rows without a usable vector take
    no part.  A row of a class of more than k equal vectors has its k
    neighbours in the class; only for smaller classes are the neighbouring
    classes' first members added, so no class is paired out.
    """
    members, links = neighbour_classes(usable(vectors, key, vector, dim), least, k=k)
    first = members.filter(F.col("position").isNotNull())
    inside = members.filter("size > 1").join(first.select("class_id", F.col("id").alias("n"), F.col("position").alias("p")), "class_id").filter(F.col("id") != F.col("n"))
    inside = inside.filter((F.col("p") <= k) | F.coalesce(F.col("position") <= k, F.lit(False))).select("id", "n")
    ranked = links.join(first.select(F.col("class_id").alias("b"), F.col("id").alias("n"), "position"), "b").filter(F.col("position") <= k)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "n"))).filter(F.col("r") <= k)
    across = members.filter(F.col("size") <= k).join(ranked.select(F.col("a").alias("class_id"), "n", "r"), "class_id").filter(F.col("r") <= k - (F.col("size") - 1)).select("id", "n")
    pairs = inside.unionAll(across)
    return pairs.select(F.least("id", "n").alias("id_a"), F.greatest("id", "n").alias("id_b")).distinct()


def _block(k: int):
    """The k best rows of each query of a tile, and what equals the last in 6 digits, of all its rows."""

    def tile(rows: list[tuple]) -> pa.RecordBatch | None:
        # repeated rows once; they are in the same tile
        qs, xs = (list({r[1]: r for r in rows if r[0] is query}.values()) for query in (True, False))
        if not qs or not xs:
            return None
        q, x = (_unit64([r[2] for r in part]) for part in (qs, xs))
        qid, xid = (np.array([r[1] for r in part], np.int64) for part in (qs, xs))
        i, j, s = _best(q, x, k, np.concatenate([qid, xid]), digits=6)
        return pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(xid[j]), pa.array(s)], names=["query_id", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for key, *r in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if rows and (out := tile(rows)) is not None:
                        yield out
                    at, rows = key, []
                rows.append(tuple(r))
        if rows and (out := tile(rows)) is not None:
            yield out

    return run


def nearest(vectors: DataFrame, key: str, vector: str, asked, k: int = K, dim: int = DIM) -> DataFrame:
    """(query_id, id, similarity, rank): for the rows that satisfy `asked` the k most similar other rows, of all rows.

    The stated queries meet all rows, in blocks of TILE by TILE, by exact
    products, and the blocks' k best are merged.  Unlike `similar_pairs` this does not rely on a
    query and its neighbour being near one codeword, so it also finds far
    neighbours; its cost is queries times rows.  Ties go to the smaller id.
    """
    ids = vectors.filter(asked).select(F.col(key).cast("long").alias("id"))
    rows = usable(vectors, key, vector, dim)
    mine = usable(vectors.filter(asked), key, vector, dim)
    n, m = rows.count(), ids.count()
    wide, high = max(1, -(-n // TILE)), max(1, -(-m // TILE))

    def pack(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    i, x, h = _usable(b)
                    own = (h[:, 1].astype(np.uint64) ^ i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                    yield pa.RecordBatch.from_arrays([pa.array((own % np.uint64(high if query else wide)).astype(np.int32)), pa.array(i), pa.array([r.tobytes() for r in x], pa.binary())], names=["own", "id", "data"])

        return run

    kind = "own int, id long, data binary"
    q = mine.mapInArrow(pack(True), kind).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda j: F.col("own") * wide + j)).alias("tile"), F.lit(True).alias("query"), "id", "data")
    x = rows.mapInArrow(pack(False), kind).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda j: j * wide + F.col("own"))).alias("tile"), F.lit(False).alias("query"), "id", "data")
    dealt = q.unionByName(x).repartition(wide * high, "tile").sortWithinPartitions("tile")
    best = dealt.mapInArrow(_block(k), "query_id long, id long, similarity double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 6).desc(), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def _regions(books: Books, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(region of each list, first tile of each region and the number of tiles): lists whose codewords are near each other, and tiles of about KNN_TILE rows."""
    lists = np.arange(books.lists)
    share = books.share
    wanted = max(1, -(-n // KNN_TILE))
    words = books.word(lists)
    seeds = _kmeans(words[share > 0] if (share > 0).any() else words, min(wanted, books.lists), 8, 11)
    region = np.argmax(words @ seeds.T - 0.5 * (seeds * seeds).sum(1), axis=1)
    size = np.bincount(region, weights=share, minlength=len(seeds)) * n
    return region, np.concatenate([[0], np.cumsum(np.maximum(1, np.ceil(size / KNN_TILE)).astype(np.int64))])


def _to_tiles(sent, probe: float):
    """Each row in one tile of its list's region; each query in all tiles of the regions that hold any of its nearest lists, a share `probe` of all, or of its dense group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, region, first = sent.value
        books = Books(*plain)
        near = min(books.lists, max(64, math.ceil(probe * books.lists)))
        step = max(64, min(1000, (1 << 22) // books.lists))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                ids, raw, h = _usable(b.select([0, 1]))
                if not len(ids):
                    continue
                asked = np.isin(ids, b.column(0).filter(b.column(2)).to_numpy())
                x = _unit(raw)
                fit = books.fit(x)
                home = np.argmax(fit, axis=1)
                r = region[home]
                tile = first[r] + ((h[:, 1].astype(np.uint64) ^ ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % (first[r + 1] - first[r])
                data = [v.tobytes() for v in raw]
                names = ["tile", "query", "id", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(np.zeros(len(ids), bool)), pa.array(ids), pa.array(data, pa.binary())], names=names)
                q = np.flatnonzero(asked)
                if not len(q):
                    continue
                top = np.argpartition(-fit[q], near - 1, axis=1)[:, :near]
                go = np.zeros((len(q), len(first) - 1), bool)
                go[np.arange(len(q))[:, None], region[top]] = True
                if len(books.dense):
                    group = books.group[home[q]]
                    for g in np.unique(group[group >= 0]):
                        go[np.ix_(group == g, np.unique(region[np.flatnonzero(books.group == g)]))] = True
                i, r = np.nonzero(go)
                width = first[r + 1] - first[r]
                at = np.repeat(np.arange(len(i)), width)
                tiles = first[r][at] + np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
                own = q[i[at]]
                yield pa.RecordBatch.from_arrays([pa.array(tiles.astype(np.int32)), pa.array(np.ones(len(own), bool)), pa.array(ids[own]), pa.array([data[k] for k in own], pa.binary())], names=names)

    return run


def nearest_by_lists(vectors: DataFrame, key: str, vector: str, asked, k: int = K, dim: int = DIM, probe: float = PROBE) -> DataFrame:
    """`nearest` through the index: a query meets the rows of the regions that hold any of its nearest lists, by exact products.

    A share `probe` of the lists is asked, as far neighbours may be at home in
    any of many; a query in a dense group asks the whole group.  Rows go to one
    tile each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.withColumn("_asked", F.coalesce(asked, F.lit(False))), key, vector, dim, "_asked")
    n = rows.count()
    books = fit(rows, n)
    region, first = _regions(books, n)
    sent = spark.sparkContext.broadcast((books.plain(), region, first))
    dealt = rows.mapInArrow(_to_tiles(sent, probe), "tile int, query boolean, id long, data binary").repartitionById(int(first[-1]), "tile")
    best = dealt.mapInArrow(_block(k), "query_id long, id long, similarity double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 6).desc(), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def p6_knn(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, similarity, rank): the 5 most similar chunks, of all, of every chunk whose id is divisible by 20."""
    return nearest_by_lists(table(spark, d, "chunks"), "id", "embedding", F.col("id") % 20 == 0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): chunks of cosine >= 0.85 of which one is among the 5 most similar of the other."""
    return similar_pairs(table(spark, d, "chunks"), "id", "embedding", 0.85)


QUERIES = {"p6_found": p6_found, "p6_knn": p6_knn}

_VECTORS = f"v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE id IS NOT NULL AND len(embedding) = {DIM} AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"

SQL = {
    "p6_found": f"""WITH {_VECTORS}, s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.id != b.id),
        r AS (SELECT a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {K})
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE s >= 0.85""",
    "p6_knn": f"""WITH {_VECTORS}, s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id != b.id WHERE a.id % 20 = 0)
        SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= {K}""",
}
