"""Reranking by late interaction: for each word of the question the likeliest word of the passage, summed.

Words have vectors of their own; the built-in ones hash the runs of three characters of a word, so inflected forms are alike, and
no model is needed. The function fills the `rerank` seam of `plans.search.retrieve`.

Nulls: a question or passage without words has a null score, as has one that the embedder fails on; rerank_order takes null as 0.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Words of a passage in one product of matrices.
BLOCK = 2048
log = logging.getLogger(__name__)


class TokenEmbedder(Protocol):
    def vectors(self, words: list[str]) -> np.ndarray: ...


class TrigramEmbedder:
    """Sums of signed places, one for each run of three characters of `^word$`: the first 32 bits of its MD5 tell place and sign."""

    #: Words remembered by one Python worker before it starts anew.
    CACHE = 50_000

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.known: dict[str, np.ndarray] = {}

    def _vector(self, word: str) -> np.ndarray:
        if (v := self.known.get(word)) is None:
            if len(self.known) >= self.CACHE:
                self.known.clear()
            v = np.zeros(self.dim, np.float32)
            whole = f"^{word}$"
            for i in range(len(whole) - 2):
                h = int(hashlib.md5(whole[i : i + 3].encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[:8], 16)
                v[h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
            self.known[word] = v
        return v

    def vectors(self, words: list[str]) -> np.ndarray:
        return np.stack([self._vector(w) for w in words])


def interaction(question: list[str], passage: list[str], embedder: TokenEmbedder) -> float:
    """The sum over the question's words of the greatest cosine with a word of the passage, at least 0."""
    q = embedder.vectors(question).astype(np.float64)
    best, own = np.zeros(len(question)), (q * q).sum(1)
    for i in range(0, len(passage), BLOCK):
        p = embedder.vectors(passage[i : i + BLOCK]).astype(np.float64)
        norms = np.sqrt(np.outer(own, (p * p).sum(1)))
        best = np.maximum(best, (q @ p.T / np.where(norms == 0, 1, norms)).max(1))
    return float(best.sum())


def late_interaction(question: Column, passage: Column, embedder: TokenEmbedder | None = None) -> Column:
    """The score of each pair of texts, from their distinct search words."""
    made = embedder or TrigramEmbedder()

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, passages in batches:
            out: list[float | None] = []
            for q, p in zip(questions, passages, strict=True):
                try:
                    out.append(interaction(list(q), list(p), made) if len(q) and len(p) else None)
                except Exception as error:  # a model that fails keeps the order, and doesn't end the search
                    log.warning("no rerank score: %s", error)
                    out.append(None)
            yield pd.Series(out, dtype="float64")

    return F.round(run(F.array_distinct(T.tokenize(question)), F.array_distinct(T.tokenize(passage))), 4)


def reranked(hits: DataFrame, embedder: TokenEmbedder | None = None) -> DataFrame:
    """hits (question, text) with rerank_score; the `rerank` of a search."""
    return hits.withColumn("rerank_score", late_interaction(F.col("question"), F.col("text"), embedder))
