"""The boundary for embedding models, with a deterministic stand-in."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(ABC):
    """A model that a worker loads once and asks in batches."""

    dim: int

    def load(self) -> None:
        """Called once in each task."""

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder(Embedder):
    """Unit vectors from SHA-256; equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        out = np.empty((len(texts), self.dim))
        for i, t in enumerate(texts):
            raw = b"".join(hashlib.sha256(f"{j}:{t}".encode()).digest() for j in range(-(-self.dim // 32)))
            out[i] = np.frombuffer(raw, np.uint8)[: self.dim] / 127.5 - 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_column(model: Embedder, text: Column) -> Column:
    """The model's vector of each text; an iterator, so that a task loads the model once."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model.load()
        for batch in batches:
            yield pd.Series(list(model.embed(batch.fillna("").tolist()).astype(np.float32)))

    return run(text)
