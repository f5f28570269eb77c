"""Embedding texts through an exchangeable embedder, in batches within each partition.

Null texts get null vectors.  An embedder whose vectors differ in length within a run raises."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    provider: str
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashes of words, normalised: needs no model and gives equal texts equal vectors."""

    provider, model = "local", "hashed-words"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``(key, vector, provider, model)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dim = None
        for pdf in batches:
            some = [(i, t) for i, t in enumerate(pdf["t"]) if t is not None]
            vec: list = [None] * len(pdf)
            for s in range(0, len(some), batch):
                part = some[s : s + batch]
                for (i, _), v in zip(part, embedder.embed([t for _, t in part])):
                    dim = dim or len(v)
                    if len(v) != dim:
                        raise ValueError(f"vectors of {len(v)} and {dim} elements")
                    vec[i] = v
            yield pd.DataFrame({"k": pdf["k"], "vector": vec, "provider": embedder.provider, "model": embedder.model})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, vector array<float>, provider string, model string").withColumnRenamed("k", key)
