"""Ingestion: texts to chunks with vectors, idempotent by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import contextualise, strip
from lectern.operators.chunking import LEAST_TEXT, OVERLAP, SIZE, chunk_documents
from lectern.operators.metadata import replace_documents
from lectern.operators.vector import Embedder, embed


def outcome(docs: DataFrame) -> DataFrame:
    """document_id, status, char_count, message: what ingestion says of each document; texts under 50 characters fail."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    return docs.select("document_id", F.when(n >= LEAST_TEXT, "completed").otherwise("failed").alias("status"), n.alias("char_count"), F.when(n < LEAST_TEXT, "The document holds too little text.").alias("message"))


def texts(rows: DataFrame) -> DataFrame:
    """Plain texts (title, text, perhaps filename) as documents: without a filename the title stands for it."""
    name = F.coalesce("filename", "title") if "filename" in rows.columns else F.col("title")
    return rows.withColumn("filename", name)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs (document_id, title, filename, source_type, text) by chunk: the payload alone, from which `searchable` makes the rest."""
    long_enough = docs.filter(F.length(strip(F.col("text"))) >= LEAST_TEXT)
    return chunk_documents(long_enough, size, overlap).withColumnRenamed("chunk", "text")


def searchable(cut: DataFrame) -> DataFrame:
    """Chunks with point_id and search_text. A point's id is a digest of document and place, so ingesting again changes nothing."""
    made = cut.withColumn("point_id", F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256))
    return made.withColumn("search_text", contextualise(F.col("title"), F.col("filename"), F.col("text")))


def points(docs: DataFrame, embedder: Embedder | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs (document_id, title, filename, source_type, text) -> point_id, the payload, search_text and embedding."""
    return searchable(chunks(docs, size, overlap)).withColumn("embedding", embed(F.col("search_text"), embedder))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    return replace_documents(stored, new, "document_id")


def reindex(stored: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Search texts and vectors anew; ids stay."""
    return stored.withColumn("search_text", contextualise(F.col("title"), F.col("filename"), F.col("text"))).withColumn("embedding", embed(F.col("search_text"), embedder))


def scan(stored: DataFrame) -> DataFrame:
    """All chunks without vectors; blank ones are left out."""
    own = F.coalesce(F.nullif(F.col("search_text"), F.lit("")), F.col("text"))
    return stored.filter("text <> ''").select("point_id", "document_id", "chunk_index", "title", "filename", "source_type", "text", own.alias("search_text"))
