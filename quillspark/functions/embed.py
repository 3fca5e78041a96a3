"""Batch embedding: the model is the user's; a deterministic hashing embedder stands in for tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 15


def hashing_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h & 0x10000 else -1
        return out

    return embed


def embed_column(text: Column, dimension: int, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Column:
    """Vectors of texts, in batches of 15; ``load`` makes the embedder once for each Python worker's stream. A text whose
    batch fails, or is null, gives null, so rows and vectors never part."""
    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load() if load else hashing_embedder(dimension)
        for texts in parts:
            out: list[list[float] | None] = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for k in range(0, len(full), BATCH):
                some = full[k : k + BATCH]
                for i, v in zip(some, embed([texts.iloc[i] for i in some])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return vectors(text)
