"""Embedding providers: what turns text into vectors. No model comes with the package; one is injected."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Called in Python workers, a batch of texts at a time; returns one vector of ``dimensions`` a text."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """A deterministic provider without a model: signed hashed words, normalised. For tests and as a fallback."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class HTTPProvider:
    """A provider behind an HTTP endpoint that takes ``{"model", "input"}`` and gives ``{"data": [{"embedding"}]}``. Off unless built."""

    def __init__(self, url: str, model: str, dimensions: int, key: str | None = None, timeout: float = 30.0):
        self.url, self.model, self.dimensions, self.key, self.timeout = url, model, dimensions, key, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        call = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": texts}).encode(), head)
        with urllib.request.urlopen(call, timeout=self.timeout) as answer:
            return np.array([d["embedding"] for d in json.load(answer)["data"]], float)


def embedded(rows: DataFrame, provider: EmbeddingProvider, text: str = "content") -> DataFrame:
    """``rows`` with ``embedding``; a provider that gives another size fails the job."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        got = np.asarray(provider.embed(texts.fillna("").tolist()), np.float32)
        if got.shape != (len(texts), provider.dimensions):
            raise ValueError(f"the provider gave {got.shape}")
        return pd.Series(list(got))

    return rows.withColumn("embedding", vectors(F.col(text)))


def check_dimensions(vectors: DataFrame, dimensions: int) -> None:
    """Raise unless all stored vectors have that size."""
    low, high = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low is not None and (low, high) != (dimensions, dimensions):
        raise ValueError(f"stored vectors have {low} to {high} dimensions, not {dimensions}")
