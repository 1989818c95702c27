"""Hybrid retrieval: vector and lexical candidates, reranking, capping, merging."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.operators import lexical, retrieval
from lectern.operators.best import Best as _Best
from lectern.operators.vector import CANDIDATES, Embedder, HashingEmbedder, dot, embed
from lectern.storage import materialise

Reranker = Callable[[DataFrame], DataFrame]


#: Questions whose vectors are sent to the tasks at once (at 384 dimensions some 12 MB); more are asked in turns.
BLOCK = 4096
#: Questions and points of one product of matrices.
TILE = (512, 2048)


def _nearest(points: DataFrame, queries: DataFrame, candidates: int, embedder: Embedder | None) -> DataFrame:
    """query_id, point_id, score: of each partition of points those nearest to every question of a block. Points without vectors are embedded as they pass."""
    asked = queries.collect()
    ids = pa.array([r["query_id"] for r in asked], to_arrow_type(queries.schema["query_id"].dataType))
    q = np.array([r["embedding"] for r in asked], float)
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema.fields, *queries.schema.fields]}
    point_type = to_arrow_type(points.schema["point_id"].dataType)
    made = None if "embedding" in points.columns else embedder or HashingEmbedder()

    def vectors(own: pa.Array) -> np.ndarray:
        if made is None:
            return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
        return made.embed(own.fill_null("").to_pylist()).astype(np.float32).astype(float)  # stored vectors have single precision

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(q), candidates)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE[1]):
                own = batch.slice(start, TILE[1])
                p = vectors(own.column(1))
                names = np.array(own.column(0).to_pylist(), object)
                for i in range(0, len(q), TILE[0]):
                    best.offer(i, q[i : i + TILE[0]] @ p.T, names)
                best.settle()
        if len(best.row):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.row)), pa.array(best.id.tolist(), point_type), pa.array(best.score)], names=["query_id", "point_id", "score"])

    own = points.select("point_id", "search_text") if made else points.filter(F.col("embedding").isNotNull()).select("point_id", "embedding")
    return own.mapInArrow(run, f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, score double")


def _vector_ranks(points: DataFrame, queries: DataFrame, candidates: int, source_type: str | None, embedder: Embedder | None) -> DataFrame:
    """query_id, point_id, score, rank."""
    if source_type is not None:
        points = points.filter(F.col("source_type") == source_type)
    blocks = max(1, -(-queries.count() // BLOCK))
    own = queries.select("query_id", "embedding")
    found = [_nearest(points, own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), candidates, embedder) for i in range(blocks)]
    scored = functools.reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 4)).filter("score >= 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= candidates)


def vector_hits(points: DataFrame, queries: DataFrame, candidates: int = CANDIDATES, source_type: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The nearest points of each question (query_id, embedding), exactly: a stated set of questions, BLOCK at a time, against all points.

    Points have an embedding, or a search_text that is embedded as they pass.
    """
    best = _vector_ranks(points, queries, candidates, source_type, embedder)
    return best.join(points.drop("embedding").filter(F.col("source_type") == source_type) if source_type is not None else points.drop("embedding"), "point_id")


def retrieve(
    points: DataFrame,
    questions: DataFrame,
    embedder: Embedder | None = None,
    index: lexical.Index | None = None,
    rerank: Reranker | None = None,
    source_type: str | None = None,
    limit: int = retrieval.LIMIT,
    final_order: str = "score",
    prefilter: bool = False,
) -> DataFrame:
    """Passages of every question (query_id, text), numbered from 1 by chunk_id. points are read three times, so they should be written before;
    without vectors (embedding) they are embedded as they pass, which costs no disk. The words are looked up in index, or else in the texts themselves.

    The source filter applies before the vector cut and, as published, after the lexical one; prefilter moves it before both.
    Without a reranker candidates keep their order.
    """
    queries = materialise(questions.select("query_id", F.col("text").alias("question"), embed(F.col("text"), embedder).alias("embedding")), "questions")
    ranks = materialise(_vector_ranks(points, queries, CANDIDATES, source_type, embedder), "near")
    pool = points.filter(F.col("source_type") == source_type) if source_type is not None and prefilter else points
    hits = lexical.search(index, questions, "query_id", "text") if index else lexical.scan(pool, "point_id", "search_text", questions, "query_id", "text")
    words = materialise(hits.select("query_id", F.col("id").alias("point_id"), F.col("rank").alias("lexical_rank"), "bm25_score"), "words")
    # of the points those that are found are read once, so neither texts nor vectors are shuffled
    wanted = ranks.select("point_id").union(words.select("point_id")).distinct()
    own = points.join(F.broadcast(wanted) if queries.count() <= BLOCK else wanted, "point_id", "left_semi")
    own = materialise(own if "embedding" in own.columns else own.withColumn("embedding", embed(F.col("search_text"), embedder)), "passages")
    near, found = ranks.join(own.drop("embedding"), "point_id"), words.join(own, "point_id")
    if source_type is not None:
        near, found = (x.filter(F.col("source_type") == source_type) for x in (near, found))
    scored = found.join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
    cosines = scored.select("query_id", "point_id", F.round(dot(F.col("embedding"), F.col("__q")), 4).alias("score"))
    extra = found.drop("embedding").withColumn("rank", F.col("lexical_rank") + CANDIDATES).drop("lexical_rank")
    hits = retrieval.unite(near, extra, cosines)
    if rerank is not None:
        hits = retrieval.rerank_order(rerank(hits.join(queries.select("query_id", "question"), "query_id")))
    capped = retrieval.trim(retrieval.cap_per_document(hits), limit)
    return retrieval.merge_adjacent(capped, final_order=final_order)
