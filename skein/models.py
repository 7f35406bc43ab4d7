"""Injected models and their deterministic stand-ins, which are no trained models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9_-]+")


def hashed_embedding(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """Signed feature hashing of tokens to unit vectors; blank texts give zeros."""
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in _TOKEN.findall((t or "").lower()):
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str | None]], np.ndarray] = hashed_embedding, batch: int = 32) -> DataFrame:
    """(key, embedding): an injected model from texts to vectors, called on batches inside Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                v = np.asarray(model(part.column(1).to_pylist()), np.float32)
                offsets = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, embedding array<float>")
