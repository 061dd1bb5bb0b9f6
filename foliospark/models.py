"""Model adapters. The default embedder needs no files: hashed character trigrams, the same text always the same vector."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            t = (t or "").strip().lower() or "(empty)"
            for j in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.md5(t[j : j + 3].encode("utf-8", "replace")).digest()[:4], "big")
                out[i, h % dim] += 1.0 if h & 1024 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def embed_column(texts: Column, make: Callable[[], Embedder]) -> Column:
    """Vectors of a text column; the model is made once in each Python worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())), index=s.index)

    return run(texts)


Reranker = Callable[[list[str], list[str]], np.ndarray]


def overlap_reranker() -> Reranker:
    """Share of the query's words that the text has; needs no files."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for q, t in zip(queries, texts):
            words = set((q or "").lower().split())
            out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
        return np.array(out)

    return score


def rerank_column(queries: Column, texts: Column, make: Callable[[], Reranker]) -> Column:
    """Scores of query and text pairs; the model is made once in each Python worker."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), index=q.index)

    return run(queries, texts)
