"""Encoding texts with a byte-level BPE vocabulary.

A text is cut into overlapping windows that are pre-tokenised on their own.
The pre-token pattern never looks back, so from any position that is a
pre-token boundary in two windows on, both agree; such a position in their
overlap is where the windows are stitched, and the pieces between stitches
are encoded by themselves.  Where two windows don't agree (one pre-token fills
their overlap) the first is made twice as long, so the ids always equal those
of the whole text.

A text's windows are stitched in the task that reads it; those of texts beyond
SPREAD code points are first dealt to many tasks, by wider windows of the
same kind.
"""

from __future__ import annotations

import builtins
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.session import materialize
from skein.sources.tables import table

#: Code points of a window's own part, and of its overlap with the next one.
WINDOW, OVERLAP = 2_048, 256
#: Code points of the windows by which a text is dealt to several tasks.
SPREAD = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: in `folder`, or where the installed package of public tokenizers has it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _cache() -> dict:
    """Lives as long as the Python worker; functions are pickled by value and bring no state along."""
    return builtins.__dict__.setdefault("_skein_cache", {})


def encoder(path: str):
    """The encoding of a rank file, made once per worker."""
    key = ("bpe", path)
    if key not in _cache():
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache()[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _cache()[key]


def _pattern():
    if "pattern" not in _cache():
        import public_tokenizers
        import regex

        _cache()["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return _cache()["pattern"]


def stitches(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[int]:
    """Where the windows of a text agree on a pre-token boundary, in order, with 0 first and the text's length last."""
    split, n = _pattern().findall, len(text)
    ends = lambda low, high: list(accumulate(map(len, split(text[low:high])), initial=low))

    cuts, low = [0], window
    own = ends(0, low + overlap)
    while low < n:
        after = ends(low, low + window + overlap)
        # the last matches may be cut short by the window's end, which the pattern looks one past
        own = own[bisect_left(own, low) : None if own[-1] == n else -2]
        both = set(own).intersection(after[: bisect_right(after, low + overlap)])
        if both:
            cuts.append(min(both))
            own, low = after, low + window
        else:
            low += low - cuts[-1]
            own = ends(cuts[-1], low + overlap)
    return [*cuts, n]


def encode_text(enc, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text, piece by piece between its stitches."""
    cuts = stitches(text, window, overlap)
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        out += enc.encode_ordinary(text[a:b])
    return out


def _encode_batches(path: str, window: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys = b.columns[:-1]
            # a few texts at a time, so that no batch of long texts holds all its ids as Python objects
            ids = []
            for t in b.columns[-1]:
                t = t.as_py()
                ids.append(pa.array(encode_text(enc, t, window, overlap) if t else [], pa.int32()))
            offsets = pa.array(_sums(len(x) for x in ids), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*keys, lists], names=[*b.schema.names[:-1], "ids"])

    return run


def _sums(sizes) -> list[int]:
    out = [0]
    for n in sizes:
        out.append(out[-1] + n)
    return out


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Pre-token boundaries of text in [low, high), as scanning from its start finds them."""
    out = [0] if low <= 0 < high else []
    for m in _pattern().finditer(text):
        if m.end() >= high:
            break
        if m.end() >= low:
            out.append(m.end())
    return out


def _edges(window: int, overlap: int):
    """Of each window, the absolute boundaries in its overlap with the window before and with the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for n, text in zip(b.column(1).to_pylist(), b.column(2)):
                text, start = text.as_py(), n * window
                heads.append([start + p for p in boundaries(text, 0, min(overlap, len(text)))])
                # the last matches may be cut short by the window's end, which the pattern looks one past
                tails.append([start + p for p in boundaries(text, window, len(text))[:-2]] if len(text) > window else [])
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "n": b.column(1), "head": pa.array(heads, pa.list_(pa.int64())), "tail": pa.array(tails, pa.list_(pa.int64()))})

    return run


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, window: int = WINDOW, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; an empty list for an empty or null text.

    Every row gives one row, whether its key is null or repeated or not.
    """
    path = path or vocabulary_path()
    src = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    here = src.filter(F.length("text") <= spread).mapInArrow(_encode_batches(path, window, overlap), "key long, ids array<int>")
    return here.unionByName(_encode_spread(src.filter(F.length("text") > spread), path, window, overlap, spread)).withColumnRenamed("key", key)


def _encode_spread(src: DataFrame, path: str, window: int, overlap: int, spread: int) -> DataFrame:
    """Texts window by window of `spread`: the boundaries in the overlaps are found by many tasks and joined, then each piece is encoded; a text of which some windows share none is encoded by one task."""
    inside, window = window, spread
    last = F.floor((F.length("text") - 1) / window).cast("int")
    # the row's own number stands for it, as keys may be null or repeated
    windows = src.select(F.monotonically_increasing_id().alias("row"), "key", "text").select("row", "key", F.explode(F.sequence(F.lit(0), last)).alias("n"), "text")
    windows = windows.select("row", "n", F.substring(F.col("text"), F.col("n") * window + 1, F.lit(window + overlap)).alias("text"), "key")
    windows = materialize(windows.repartition("row", "n"))
    edges = materialize(windows.select("row", "n", "text").mapInArrow(_edges(window, overlap), "row long, n int, head array<long>, tail array<long>"))
    before = edges.select("row", (F.col("n") + 1).alias("n"), F.col("tail").alias("_tail"))
    shared = F.array_min(F.array_intersect("head", "_tail"))
    cuts = edges.join(before, ["row", "n"], "left").select("row", "n", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(shared).alias("cut"))
    whole = Window.partitionBy("row")
    cuts = cuts.select("row", "n", "cut", F.min(F.col("cut").isNotNull()).over(whole).alias("stitched"), F.lead("cut").over(whole.orderBy("n")).alias("next"))
    origin = F.col("n").cast("long") * window
    low = F.when(F.col("stitched"), F.col("cut")).otherwise(origin)
    # the last window's own part ends with its text
    high = F.when(F.col("stitched") & F.col("next").isNotNull(), F.col("next")).otherwise(origin + window)
    own = windows.join(cuts, ["row", "n"]).select("row", "n", F.when(F.col("stitched"), F.col("n")).otherwise(0).alias("run"), F.substring(F.col("text"), (low - origin + 1).cast("int"), (high - low).cast("int")).alias("text"))
    pieces = own.groupBy("row", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
    coded = pieces.mapInArrow(_encode_batches(path, inside, overlap), "row long, run int, ids array<int>")
    ids = coded.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"])).alias("ids"))
    return ids.join(windows.filter("n = 0").select("row", "key"), "row").select("key", "ids")


def decode(coded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the texts, from the concatenated bytes of the ids; bytes that are no valid UTF-8 are replaced."""
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode_bytes(x or []).decode("utf-8", errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return coded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids): every document's byte_bpe_50k ids."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
