"""Subject areas of documents by class-association rules.

Sentences of labelled documents are the transactions: their words and pairs of
neighbouring words, weighed by the document's subjects.  Parallel
frequent-pattern growth mines the itemsets with their weight of each subject:
items are counted in parallel and ranked, each sentence is dealt to the groups
of its items up to the last item of the group, and every group grows its own
tree.  An itemset that tells a subject is a rule; a rule that tells no more than
a rule on a part of its items is dropped.  The rules' odds are calibrated on
labelled documents that were held out.  A sentence's evidence for a subject is
that of its strongest matching rule, weighed by the subjects that the rest of
its document is about.
"""

from __future__ import annotations

import math
import operator
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.session import materialize, shuffle_partitions
from skein.sources.tables import table

#: Labelled documents that rules are mined from; with more, a hash of the id chooses about so many.  One in HELD_OUT of them is for calibration.
LABELLED, HELD_OUT = 20_000, 5
#: Documents and sentences in which an item, and sentences in which several items together must stand.
MIN_DOCS, MIN_SUPPORT, LONGER_SUPPORT = 3, 5, 8
#: Least share of an itemset's sentences that have the subject, and how many times the subject's own share that must be.
CONFIDENCE, LIFT = 0.4, 2.0
#: Share of the subject's documents, by its own share, from which an item takes part in itemsets.
HINT = 2.0
#: How many times as telling as any part of its items a rule must be.
GAIN = 1.25
#: Share of a document's sentences that makes a subject.
SHARE = 0.25

# The hyphen stands first, so that the search runs from hyphen to hyphen.
_HYPHEN = re.compile(r"-(?<=[^\W\d_]-)[^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
_INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_TOKENS = re.compile(r"[^\W_]+|[.!?](?=\s|$)|\n[^\S\n]*\n|\x0c")
#: Tokens that end a stretch: a sentence, or something else.
_STOP = frozenset(".!?")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words, with . ! and ? that end a sentence and breaks between blocks as tokens of their own."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return _TOKENS.findall(text.lower())


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence: a stretch that ends with . ! or ? and has at least four words; headings and page lines are none."""
    out, start = [], 0
    found = tokens(text)
    for i, t in enumerate(found):
        if not t[0].isalnum():
            if t in _STOP and i - start >= 4:
                out.append(found[start:i])
            start = i + 1
    return out


def items_of(ws: list[str]) -> set[str]:
    """Words of at least four letters, and pairs of neighbouring words, without numbers."""
    plain = [not w[0].isdigit() for w in ws]
    out = {w for w, p in zip(ws, plain) if p and len(w) > 3}
    out.update(f"{a} {b}" for a, b, p, q in zip(ws, ws[1:], plain, plain[1:]) if p and q)
    return out


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, in how many documents each item stands and with what weight of each subject."""
    seen: dict[str, int] = {}
    docs: list[int] = []
    weights: list[list[float]] = []
    for b in batches:
        for t, w in zip(b.column(0), b.column(1).to_pylist()):
            some = [(k, v) for k, v in enumerate(w) if v]
            for x in set().union(*map(items_of, sentences(t.as_py()))):
                i = seen.setdefault(x, len(docs))
                if i == len(docs):
                    docs.append(1), weights.append(list(w))
                else:
                    docs[i] += 1
                    own = weights[i]
                    for k, v in some:
                        own[k] += v
    names = list(seen)
    for k in range(0, len(names), 50_000):
        yield pa.RecordBatch.from_pydict({"item": pa.array(names[k : k + 50_000]), "docs": pa.array(docs[k : k + 50_000], pa.int64()), "w": pa.array(weights[k : k + 50_000], pa.list_(pa.float64()))})


def _deal(sent, groups: int):
    """(g, items, w, n): each sentence's items by rank, for each group up to the group's last one in it, with its document's weights; equal ones of a batch once, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank: dict[str, int] = sent.value
        for b in batches:
            seen: Counter = Counter()
            for t, w in zip(b.column(0), b.column(1).to_pylist()):
                w = np.array(w).tobytes()
                for said in sentences(t.as_py()):
                    own = sorted(rank[x] for x in items_of(said) if x in rank)
                    packed, dealt = array("i", own).tobytes(), set()
                    for k in range(len(own) - 1, -1, -1):
                        g = own[k] % groups
                        if g not in dealt:
                            dealt.add(g)
                            seen[g, packed[: 4 * k + 4], w] += 1
            yield pa.RecordBatch.from_pydict({"g": pa.array([k[0] for k in seen], pa.int32()), "items": pa.array([k[1] for k in seen], pa.binary()), "w": pa.array([k[2] for k in seen], pa.binary()), "n": pa.array(list(seen.values()), pa.int32())})

    return run


class Tree:
    """A frequent-pattern tree over (items by rank, count, weights); equal rows should come as one."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, np.ndarray]]):
        self.item, self.parent = [-1], [-1]
        self.nodes: dict[int, list[int]] = {}
        child: dict[tuple[int, int], int] = {}
        ends, counts, weights = [], [], []
        for items, n, w in rows:
            at = 0
            for x in items:
                to = child.get((at, x))
                if to is None:
                    to = child[at, x] = len(self.item)
                    self.item.append(x), self.parent.append(at)
                    self.nodes.setdefault(x, []).append(to)
                at = to
            ends.append(at), counts.append(n), weights.append(w)
        self.count = np.zeros(len(self.item), np.int64)
        self.weight = np.zeros((len(self.item), len(rows[0][2]) if rows else 0))
        np.add.at(self.count, ends, counts)
        if rows:
            np.add.at(self.weight, ends, np.stack(weights))
        for k in range(len(self.item) - 1, 0, -1):  # children come after their parents
            self.count[self.parent[k]] += self.count[k]
            self.weight[self.parent[k]] += self.weight[k]

    def path(self, node: int) -> tuple[int, ...]:
        """Items above a node, from the root on."""
        out, at = [], self.parent[node]
        while at > 0:
            out.append(self.item[at])
            at = self.parent[at]
        return tuple(out[::-1])


def _once(rows) -> list[tuple[tuple[int, ...], int, np.ndarray]]:
    """(items, count, weights) rows with equal items added up."""
    out: dict[tuple[int, ...], list] = {}
    for items, n, w in rows:
        if (own := out.get(items)) is None:
            out[items] = [n, w]
        else:
            own[0] += n
            own[1] = own[1] + w
    return [(items, n, w) for items, (n, w) in out.items()]


def grow(tree: Tree, wanted, prior: np.ndarray, support: int, longer: int, suffix: tuple[int, ...] = (), above: int = -1) -> Iterator[tuple[tuple[int, ...], int, np.ndarray]]:
    """(items, count, weights) of the telling itemsets that end with an item for which `wanted` holds, by recursion over conditional trees; of at least `support` sentences, those of several items of `longer`.

    An itemset of as many sentences as without its newest item tells the same
    as without it, and so do all that hold it; one that no further item can
    make GAIN times as telling has no rule beyond it.  Neither is grown on.
    """
    for x, nodes in tree.nodes.items():
        if not wanted(x):
            continue
        n = int(tree.count[nodes].sum())
        if n < support or n == above:
            continue
        w = tree.weight[nodes].sum(axis=0)
        share = (w + prior) / (n + 1)
        body = (x, *suffix)
        if (share >= CONFIDENCE / GAIN).any():
            yield body, n, w
        if not ((share * GAIN < 1) & (w >= CONFIDENCE * longer)).any():
            continue
        base = [(tree.path(k), int(tree.count[k]), tree.weight[k]) for k in nodes]
        often: Counter = Counter()
        for items, k, _ in base:
            for y in items:
                often[y] += k
        keep = {y for y, k in often.items() if longer <= k < n}
        if keep:
            yield from grow(Tree(_once((tuple(y for y in items if y in keep), k, v) for items, k, v in base)), lambda y: True, prior, longer, longer, body, n)


def _mine(groups: int, prior: list[float]):
    """Telling itemsets of each group; the groups' sentences come one group after another."""
    prior = np.array(prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(g: int, seen: Counter) -> pa.RecordBatch:
            known: dict[bytes, np.ndarray] = {}
            rows = []
            for (items, w), n in seen.items():
                if w not in known:
                    known[w] = np.frombuffer(w)
                rows.append((tuple(array("i", items)), n, known[w] * n))
            got = list(grow(Tree(_once(rows)), lambda x: x % groups == g, prior, MIN_SUPPORT, LONGER_SUPPORT))
            return pa.RecordBatch.from_pydict({"items": pa.array([b for b, _, _ in got], pa.list_(pa.int32())), "n": pa.array([n for _, n, _ in got], pa.int64()), "w": pa.array([w.tolist() for _, _, w in got], pa.list_(pa.float64()))})

        at, seen = None, Counter()
        for b in batches:
            for g, items, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if g != at and seen:
                    yield found(at, seen)
                    seen = Counter()
                at = g
                seen[items, w] += n
        if seen:
            yield found(at, seen)

    return run


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, weight): each document's subjects as spelled in subjects; its votes, without a reader's repeats, sum to one.

    Labels that name no subject, nulls among them, are dropped.  A subject
    with less than half the votes of the document's leading one is dropped.
    """
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    known = subjects.select(F.col("subject").alias("name"), key(F.col("subject")).alias("key")).dropDuplicates(["key"])
    votes = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", key(F.col("subject")).alias("key"), "annotator").distinct()
    votes = votes.join(known, "key").groupBy("doc_id", F.col("name").alias("subject")).agg(F.count(F.lit(1)).alias("v"))
    doc = Window.partitionBy("doc_id")
    votes = votes.withColumn("top", F.max("v").over(doc)).filter(F.col("v") * 2 >= F.col("top"))
    return votes.select("doc_id", "subject", (F.col("v") / F.sum("v").over(doc)).alias("weight"))


def prune(found: dict[tuple[str, ...], np.ndarray], prior: np.ndarray) -> dict[tuple[str, ...], np.ndarray]:
    """The rules among itemsets with their shares of each subject: shares that are telling, and GAIN times those of every part of the items; other shares become 0.

    A part that was not found tells less than any rule.
    """
    out = {}
    shares = np.stack(list(found.values())) if found else np.zeros((0, len(prior)))
    telling = (shares >= CONFIDENCE) & (shares >= LIFT * prior)
    for body, share, fine in zip(found, shares, telling):
        if not fine.any():
            continue
        if len(body) == 1:
            out[body] = share
            continue
        for part in chain.from_iterable(combinations(body, k) for k in range(1, len(body))):
            if (less := found.get(part)) is not None:
                fine &= share > GAIN * less
                if not fine.any():
                    break
        else:
            out[body] = np.where(fine, share, 0.0)
    return out


def _platt(evidence: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve through hits of n at each evidence, by Newton steps; the identity where too little was held out."""
    if n.sum() < 200 or hits.sum() < 5 or (n - hits).sum() < 5:
        return 1.0, 0.0
    x, ab = np.stack([evidence, np.ones_like(evidence)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        slope = x.T @ (hits - n * p) - 1e-3 * (ab - [1.0, 0.0])
        ab = ab + np.clip(np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope), -1, 1)
    return (float(ab[0]), float(ab[1])) if ab[0] > 0.1 else (1.0, 0.0)


def _held_out(sent):
    """(e, n, hits): of held-out sentences, by their strongest evidence in tenths, how many there are and how many name a subject of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(sent.value), {}
        for b in batches:
            own = np.array(b.column(1).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            e, doc, _ = scorer.evidence(b.column(0).to_pylist())
            best = e.argmax(axis=1)
            for x, y in zip(np.round(e[np.arange(len(e)), best] * 10).astype(int).tolist(), (own[doc, best] > 0).tolist()):
                k = seen.setdefault(x, [0, 0])
                k[0] += 1
                k[1] += y
        yield pa.RecordBatch.from_pydict({"e": pa.array(list(seen), pa.int32()), "n": pa.array([v[0] for v in seen.values()], pa.int64()), "hits": pa.array([v[1] for v in seen.values()], pa.int64())})

    return run


def mine_rules(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> dict:
    """{"subjects": names, "prior": shares, "rules": {itemset: log-odds per subject}, "curve": (slope, intercept)} from the labelled documents.

    The rules come from at most about LABELLED documents, so their number is
    bounded by that sample.
    """
    spark = docs.sparkSession
    clean = materialize(clean_labels(labels, subjects))
    names = sorted(r[0] for r in subjects.filter(F.col("subject").isNotNull()).select("subject").distinct().collect())
    n = clean.select("doc_id").distinct().count()
    if n > LABELLED:
        clean = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * LABELLED / n))
    # a document of two subjects counts for either with the root of its share
    share = [F.coalesce(F.sum(F.when(F.col("subject") == s, F.col("weight"))), F.lit(0.0)) for s in names]
    per_doc = clean.groupBy("doc_id").agg(F.array(*[F.sqrt(x) for x in share]).alias("w"), F.array(*share).alias("share"))
    text = docs.filter(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", "text")
    text = materialize(text.join(F.broadcast(per_doc), "doc_id"))  # at most about LABELLED documents
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(HELD_OUT)) == 0
    fit = text.filter(~held).select("text", "w")
    total, *shares = text.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.get("share", F.lit(i))), F.lit(0.0)) for i in range(len(names))]).first()
    prior = np.array(shares) / max(1, total)
    model = {"subjects": names, "prior": prior.tolist(), "rules": {}, "curve": (1.0, 0.0)}
    if not total or not names:
        return model
    part = fit.mapInArrow(_count_items, "item string, docs long, w array<double>")
    sums = part.groupBy("item").agg(F.sum("docs").alias("docs"), *[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(len(names))]).filter(F.col("docs") >= MIN_DOCS)
    hint = reduce(operator.or_, [F.col(f"w{i}") >= HINT * float(p) * F.col("docs") for i, p in enumerate(prior) if p > 0], F.lit(False))
    ranked = [r[0] for r in sums.filter(hint).orderBy(F.desc("docs"), "item").select("item").collect()]
    groups = max(32, 4 * shuffle_partitions(spark))
    rank = spark.sparkContext.broadcast({x: i for i, x in enumerate(ranked)})
    dealt = fit.mapInArrow(_deal(rank, groups), "g int, items binary, w binary, n int")
    mined = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_mine(groups, prior.tolist()), "items array<int>, n long, w array<double>")
    got = mined.toArrow()
    share_of = (got.column("w").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(names)) + prior) / (got.column("n").to_numpy()[:, None] + 1)
    found = {tuple(sorted(ranked[i] for i in items)): v for items, v in zip(got.column("items").to_pylist(), share_of)}
    odds = lambda v: np.log(np.clip(v, 0.01, 0.97) / (1 - np.clip(v, 0.01, 0.97))).astype(np.float32)
    model["rules"] = {k: odds(v) for k, v in prune(found, prior).items()}
    sent = spark.sparkContext.broadcast(model)
    rest = text.filter(held).select("text", "w").mapInArrow(_held_out(sent), "e int, n long, hits long").groupBy("e").agg(F.sum("n"), F.sum("hits")).collect()
    if rest:
        e, n, hits = (np.array(c, dtype=float) for c in zip(*rest))
        model["curve"] = _platt(e / 10, n, hits)
    return model


class _Codes(dict):
    """Numbers of the words in rules; 0 of other words, -1 of what ends a sentence, -2 of other breaks."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, t: str) -> int:
        if len(self) > len(self.known) + 500_000:  # other words are kept only to be found fast
            self.clear()
            self.update(self.known)
        code = self[t] = self.known.get(t) or (-1 if t in _STOP else -2 if t[0] <= " " else 0)
        return code


class Scorer:
    """The rules, laid out for looking up many sentences at a time."""

    def __init__(self, model: dict):
        self.subjects = model["subjects"]
        bodies = list(model["rules"])
        slope, intercept = model["curve"]
        self.odds = slope * np.stack([model["rules"][b] for b in bodies] or [np.zeros(len(self.subjects), np.float32)]).astype(np.float32) + np.float32(intercept)
        # an item's number: its rule's, or beyond them for items that stand in longer rules only
        single = {b[0]: i for i, b in enumerate(bodies) if len(b) == 1}
        longer = [(b, i) for i, b in enumerate(bodies) if len(b) > 1]
        for b, _ in longer:
            for x in b:
                single.setdefault(x, len(bodies) + len(single))
        self.known = len(bodies)
        words = {w for x in single for w in x.split(" ")}
        self.code = _Codes({w: i + 1 for i, w in enumerate(sorted(words))})
        size = self.size = len(words) + 1
        self.word = np.full(size, -1)
        pairs = []
        for x, i in single.items():
            if " " in x:
                a, b = x.split(" ")
                pairs.append((self.code[a] * size + self.code[b], i))
            else:
                self.word[self.code[x]] = i
        pairs.sort()
        self.pair_key, self.pair = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ((), ())))
        self.mask = (1 << max(10, 4 + len(pairs).bit_length())) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[self.pair_key * 0x9E3779B1 >> 12 & self.mask] = True
        # longer rules are looked up under the item that fewest of them have
        uses = Counter(x for b, _ in longer for x in b)
        self.items = 1 + max(single.values(), default=0)
        under: dict[int, list] = {}
        for b, i in longer:
            first = min(b, key=lambda x: (uses[x], x))
            under.setdefault(single[first], []).append((i, [single[x] for x in b if x != first]))
        self.under_key = np.array(sorted(under), np.int64)
        flat = [r for k in sorted(under) for r in under[k]]
        self.under_begin = np.cumsum([0, *(len(under[k]) for k in sorted(under))])
        self.under_rule = np.array([i for i, _ in flat], np.int64)
        width = max((len(r) for _, r in flat), default=0)
        self.under_rest = np.array([r + [-1] * (width - len(r)) for _, r in flat], np.int64).reshape(len(flat), width)

    def _longer(self, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, rule) of the rules of several items, all of which stand in a sentence."""
        if not len(self.under_key):
            return at[:0], at[:0]
        key = np.unique(at * self.items + item)
        at, item = key // self.items, key % self.items
        place = np.minimum(np.searchsorted(self.under_key, item), len(self.under_key) - 1)
        mine = self.under_key[place] == item
        at, place = at[mine], place[mine]
        begin, count = self.under_begin[place], np.diff(self.under_begin)[place]
        row = np.repeat(np.arange(len(at)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - begin, count)
        fine = np.ones(len(row), bool)
        for rest in self.under_rest[number].T:
            want = at[row] * self.items + rest
            fine &= (rest < 0) | (key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want)
        return at[row[fine]], self.under_rule[number[fine]]

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(odds per subject, text) of the sentences that any rule matches, and the number of sentences of each text."""
        found = [tokens(t) for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        # -1 ends a sentence, -2 (other breaks, and texts) ends something else
        codes = np.full(int(size.sum()) + len(texts), -2, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        if len(texts):
            inside = np.ones(len(codes), bool)
            inside[begin + size] = False
            codes[inside] = np.fromiter(map(self.code.__getitem__, chain.from_iterable(found)), np.int64, int(size.sum()))
        ends = codes < 0
        stop = np.flatnonzero(ends)
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        good = (codes[stop] == -1) & (stop - start >= 4)
        doc_of = np.searchsorted(begin, start, "right") - 1
        count = np.bincount(doc_of[good], minlength=len(texts))[: len(texts)] if len(texts) else np.zeros(0)
        # hits: words, then pairs of neighbours
        at = np.flatnonzero(codes > 0)
        item = self.word[codes[at]]
        two = at[:-1][np.diff(at) == 1] if len(at) else at
        key = codes[two] * self.size + codes[two + 1] if len(two) else two
        if len(self.pair_key) and len(key):
            maybe = self.maybe[key * 0x9E3779B1 >> 12 & self.mask]  # most pairs are no items
            two, key = two[maybe], key[maybe]
            place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            same = self.pair_key[place] == key
            at, item = np.concatenate([at, two[same]]), np.concatenate([item, self.pair[place[same]]])
        at, item = at[item >= 0], item[item >= 0]
        sentence = np.cumsum(ends)[at]
        fine = good[sentence]
        sentence, item = sentence[fine], item[fine]
        more, rule = self._longer(sentence, item)
        sure = item < self.known
        sentence, rule = np.concatenate([sentence[sure], more]), np.concatenate([item[sure], rule])
        order = np.argsort(sentence, kind="stable")
        sentence, rule = sentence[order], rule[order]
        if not len(rule):
            return np.zeros((0, len(self.subjects)), np.float32), np.zeros(0, np.int64), count
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        return np.maximum.reduceat(self.odds[rule], first, axis=0), doc_of[sentence[first]], count

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """(texts, subjects): the share of each text's sentences about each subject, 0 without sentences.

        A sentence's odds for a subject are the strongest of its rules'.  They
        are mixed with the document's own shares, found by a few rounds of
        expectation maximisation, so that a word of two subjects counts for
        the one that the document is about.
        """
        k, n = len(self.subjects), len(texts)
        out = np.zeros((n, k))
        e, doc, count = self.evidence(texts)
        top = e.max(axis=1) if len(e) else np.zeros(0)
        strong = top >= math.log(CONFIDENCE / (1 - CONFIDENCE)) - 1e-6
        e, doc, top = e[strong], doc[strong], top[strong]
        if not len(doc):
            return out
        like = np.exp(e - top[:, None])
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own = np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]])) - 1
        mix = np.full((len(first), k), 1.0 / k)
        for _ in range(8):
            post = like * mix[own]
            post /= post.sum(axis=1, keepdims=True)
            mix = np.add.reduceat(post, first, axis=0) + 0.1 / k
            mix /= mix.sum(axis=1, keepdims=True)
        np.add.at(out, (doc, post.argmax(axis=1)), 1.0)
        return out / np.maximum(count, 1)[:, None]


def _classify(sent, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                s = scorer.shares(b.column(1).to_pylist())
                at, subject = np.nonzero(s >= share)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([scorer.subjects[i] for i in subject], pa.string()), pa.array(s[at, subject])], names=["doc_id", "subject", "share"])

    return run


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share) of every document, labelled or not: subjects that at least `share` of its sentences are about.

    Null and blank texts, and texts without a sentence, have no subject.
    Without labels there are no rules and no rows.  Repeated documents give
    their rows each.  The rules are sent to the workers; documents are read
    whole, in one pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(mine_rules(docs, labels, subjects))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_classify(sent, share), "doc_id long, subject string, share double")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, subject, share) of each document's subjects."""
    return subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, subject): subjects that at least a quarter of the document's sentences are about."""
    return p10_shares(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """(subject, documents): how many documents are about each subject."""
    n = p10_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "subjects").select("subject").join(n, "subject", "left").select("subject", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_composition": p10_composition}
