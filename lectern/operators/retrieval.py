"""What happens to candidates between search and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_DOCUMENT, LIMIT, STITCH = 3, 12, 200


def unite(vector: DataFrame, lexical: DataFrame, cosines: DataFrame, key: str = "point_id", by: str = "query_id") -> DataFrame:
    """Vector hits and the lexical hits that aren't among them, with their cosine (0 if unknown)."""
    extra = lexical.join(vector.select(by, key), [by, key], "left_anti").join(cosines, [by, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return vector.unionByName(extra, allowMissingColumns=True)


def rerank_order(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """New ranks by rerank_score, missing ones as 0, keeping the old order among equals."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "rank")))


def cap_per_document(hits: DataFrame, most: int = PER_DOCUMENT, by: str = "query_id", key: str = "point_id") -> DataFrame:
    """The first hits of each document in rank order; hits without a document aren't grouped; 0 is no cap."""
    if most <= 0:
        return hits
    group = F.coalesce(F.concat(F.lit("d"), F.col("document_id").cast("string")), F.concat(F.lit("p"), F.col(key).cast("string")))
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(by, group).orderBy("rank"))).filter(F.col("__n") <= most).drop("__n")


def trim(hits: DataFrame, limit: int = LIMIT, by: str = "query_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).filter(F.col("rank") <= limit)


def stitch(first: Column, second: Column, most: int = STITCH) -> Column:
    """second appended to first without the overlap, if one of 21 to `most` characters is there; else on a new line."""
    longest = F.least(F.length(first), F.length(second), F.lit(most))
    sizes = F.when(longest > 20, F.sequence(longest, F.lit(21), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    overlap = F.try_element_at(F.filter(sizes, lambda n: F.right(first, n) == F.left(second, n)), F.lit(1))
    return F.when(overlap.isNotNull(), F.concat(first, F.substr(second, overlap + 1))).otherwise(F.concat(first, F.lit("\n"), second))


def islands(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """hits with the number of their run of neighbouring chunks of a document."""
    order = Window.partitionBy(by).orderBy(F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.coalesce("chunk_index", F.lit(0)), "rank")
    last_doc, last_index = F.lag("document_id").over(order), F.lag("chunk_index").over(order)
    joins = F.col("document_id").eqNullSafe(last_doc) & F.coalesce(F.col("chunk_index") == last_index + 1, F.lit(False))
    starts = F.when(joins & (F.row_number().over(order) > 1), 0).otherwise(1)
    return hits.withColumn("__start", starts).withColumn("island", F.sum("__start").over(order)).drop("__start")


def merge_adjacent(hits: DataFrame, by: str = "query_id", final_order: str = "score") -> DataFrame:
    """One row for each run of neighbouring chunks: stitched text, last index, best score, renumbered by score.

    final_order "rerank" keeps the order that reranking gave instead.
    """
    runs = islands(hits, by).groupBy(by, "island").agg(
        F.min_by("document_id", F.coalesce("chunk_index", F.lit(0))).alias("document_id"),
        F.max("chunk_index").alias("chunk_index"),
        F.max("score").alias("score"),
        F.min("rank").alias("rank"),
        F.count("*").alias("merged"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "text"))).alias("parts"),
    )
    texts = F.transform("parts", lambda p: p["text"])
    text = F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), F.element_at(texts, 1), lambda done, x: stitch(done, x))
    order = Window.partitionBy(by).orderBy(*([F.desc("score"), "island"] if final_order == "score" else ["rank"]))
    return runs.withColumn("text", text).withColumn("chunk_id", F.row_number().over(order)).drop("parts", "rank", "island")
