"""Exact cosine search over normalised vectors, and the built-in embedder."""

from __future__ import annotations

import hashlib
import itertools
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES, THRESHOLD = 48, 0.35


class Embedder(Protocol):
    """Turns texts into unit vectors of a fixed length."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Hashes(dict):
    """The first 32 bits of a word's MD5, remembered for `most` words before it starts anew."""

    def __init__(self, most: int):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = int(hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[:8], 16)
        return h


class HashingEmbedder:
    """Feature hashing of words, deterministic and without a model: the first 32 bits of a word's MD5 tell its place and sign."""

    #: Words remembered by one Python worker before it starts anew.
    CACHE = 500_000

    def __init__(self, dim: int = 384):
        self.dim = dim
        self.known = _Hashes(self.CACHE)

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        h = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        rows = np.repeat(np.arange(len(texts)), list(map(len, words)))
        out = np.bincount(rows * self.dim + h % self.dim, weights=np.where(h >> 16 & 1, 1.0, -1.0), minlength=len(texts) * self.dim).reshape(-1, self.dim)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
        return out / np.where(norm == 0, 1, norm)


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """The vector of each text, in Arrow batches."""
    made = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(made.embed(texts.fillna("").tolist()).astype(np.float32)))

    return run(text)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    kind = "array<double>"
    return F.aggregate(F.zip_with(a.cast(kind), b.cast(kind), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(points: DataFrame, query: list[float], key: str = "vec_id", limit: int = CANDIDATES, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """The points nearest to one query; a filter applies before the cut. Rounded scores are ranked, ties go to the smaller key."""
    if where is not None:
        points = points.filter(where)
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = points.withColumn("score", F.round(dot(F.col("embedding"), vector), 4)).filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(limit)


def relevant(hits: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Whether any hit of a query reaches the threshold."""
    return hits.groupBy(*by).agg(F.coalesce(F.max("score") >= threshold, F.lit(False)).alias("relevant"))
