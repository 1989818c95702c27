"""Figures of articles: new ones are taken from a folder of files into a table, and every candidate is counted by its reason.

A run that was cut off is repeated as it is: what it had stored is found by its address and skipped.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.sources import markup
from lectern.sources.markup import FIGURES, decorative
from lectern.storage import exists, materialise

SOURCE = "pmc_figure"
PARSED = "struct<licence:string,figures:array<struct<label:string,caption:string,href:string,fig_id:string>>>"
STORED = (
    "image_id string, document_id long, filename string, storage_path string, mime_type string, file_size long, source_type string, "
    "source_url string, caption string, licence string, is_deidentified boolean, status string, content binary, day date"
)

# The first bytes of image files.
MARKS = {"image/png": "^89504E470D0A1A0A", "image/jpeg": "^FFD8FF", "image/gif": "^474946383[79]61", "image/bmp": "^424D", "image/tiff": "^(49492A00|4D4D002A)", "image/webp": "^52494646.{8}57454250"}

#: What can become of a document without a figure, and of a figure.
DOCUMENT_REASONS = ["no number", "unreadable", "no figures"]
FIGURE_REASONS = ["decorative", "existing", "failed", "stored"]


def parsed(texts: Column) -> Column:
    """Licence and figures of an article's markup, whatever its length; null where it can't be read."""

    def one(text: str | None) -> dict:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return {"licence": None, "figures": None}
        return {"licence": markup.licence(root), "figures": markup.figures(root)}

    @F.pandas_udf(PARSED)
    def run(given: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in given], columns=["licence", "figures"])

    return run(texts)


def kind_of(content: Column) -> Column:
    """The type that the first bytes of an image tell; null for all else."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    kind = F.lit(None).cast("string")
    for name, mark in MARKS.items():
        kind = F.when(head.rlike(mark), name).otherwise(kind)
    return kind


def candidates(documents: DataFrame, archive: str, most: int = FIGURES) -> DataFrame:
    """documents (document_id, created_at, source_url, filename, markup) -> a row for each of the first `most` figures, or one for a document without any.

    document_id, created_at, pos, url, licence, figure, and the reason where it is known from the article alone. Columns
    of other names are ignored; a null document_id, link or name is allowed.
    """
    number = markup.article_number(F.col("source_url"), F.col("filename"))
    # an article without a number isn't parsed
    read = documents.select("document_id", "created_at", number.alias("number"), parsed(F.when(number != "", F.col("markup"))).alias("article"))
    rows = read.select("document_id", "created_at", "number", "article.licence", F.col("article.figures").isNotNull().alias("readable"), F.posexplode_outer(F.slice("article.figures", 1, most)).alias("pos", "figure"))
    href = F.coalesce("figure.href", F.lit(""))
    reason = (
        F.when(F.col("number") == "", "no number").when(~F.col("readable"), "unreadable").when(F.col("pos").isNull(), "no figures")
        .when((href == "") | decorative(href), "decorative")
    )
    url = F.when(reason.isNull(), markup.figure_url(F.lit(archive), F.col("number"), href))
    return rows.select("document_id", "created_at", "pos", url.alias("url"), "licence", "figure", reason.alias("reason"))


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{store}/figures") if exists(spark, f"{store}/figures") else spark.createDataFrame([], STORED)


def judged(rows: DataFrame, known: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with their reasons, and the files that are to be stored (url, content, mime_type).

    Of the candidates with one address that of the newest document is stored (ties: the least document_id, then place); the others
    find it existing. One address can be that of very many documents: the facts of an address are one row, and the
    join that brings them back is a left one, which adaptive execution splits where it is skewed.
    """
    newest = F.struct(F.col("created_at").isNull().alias("none"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), F.col("document_id").isNull().alias("no_id"), "document_id", "pos")
    open_ = rows.filter("reason IS NULL")
    firsts = open_.groupBy("url").agg(F.min(newest).alias("first"))
    new = firsts.join(known.select(F.col("source_url").alias("url")), "url", "left_anti")
    # of files under one address the greatest by bytes
    wanted = files.join(new.select("url"), "url", "left_semi").groupBy("url").agg(F.max("content").alias("content"))
    taken = materialise(wanted.select("url", "content", kind_of(F.col("content")).alias("mime_type")).filter("mime_type IS NOT NULL"), "figure-files")
    facts = new.join(taken.select("url", F.lit(True).alias("good")), "url", "left").select("url", "first", F.coalesce("good", F.lit(False)).alias("good"))
    # rows without an address get one of their own that meets nothing, so that they don't come together
    lone = F.coalesce("url", F.concat(F.lit("\n"), F.xxhash64("document_id", "pos").cast("string")))
    joined = rows.withColumn("__key", lone).join(facts.select(F.col("url").alias("__key"), "first", "good"), "__key", "left")
    own = F.col("first").eqNullSafe(newest)
    reason = F.when(F.col("first").isNull(), "existing").when(~F.col("good"), "failed").when(own, "stored").otherwise("existing")
    return joined.withColumn("reason", F.coalesce("reason", reason)).select(*rows.columns), taken


def top_up(documents: DataFrame, files: DataFrame, store: str, archive: str, day: Column | None = None, limit: int | None = None, most: int = FIGURES) -> tuple[DataFrame, dict[str, int]]:
    """Takes the new figures of documents into store/figures; the candidates with their reasons, and the run's counters.

    documents: see `candidates`; limit: only so many of the newest (ties: the least document_id). files: url and content
    (`from_folder`). An empty or missing file, or one that is no image, has failed. Repeated documents count as often as they come.
    """
    spark = documents.sparkSession
    if limit is not None:
        documents = documents.orderBy(F.desc_nulls_last("created_at"), "document_id").limit(limit)
    rows = materialise(candidates(documents, archive, most), "figure-candidates")
    marked, taken = judged(rows, stored(spark, store), files)
    scanned = Observation()
    is_reason = {name: F.count_if(F.col("reason") == name).alias(name) for name in DOCUMENT_REASONS + FIGURE_REASONS}
    documents_seen = F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("documents")
    told = materialise(marked.observe(scanned, documents_seen, F.count("*").alias("candidates"), *is_reason.values()), "figure-reasons")

    day = day if day is not None else F.current_date()
    image_id = F.sha2("source_url", 256)
    fresh = told.filter("reason = 'stored'").join(taken, "url").withColumnsRenamed({"url": "source_url"})
    caption = F.nullif(F.concat_ws(" ", F.nullif("figure.label", F.lit("")), F.nullif("figure.caption", F.lit(""))), F.lit(""))
    made = fresh.select(
        image_id.alias("image_id"), "document_id", F.col("figure.href").alias("filename"),
        layout.relative_path(image_id, F.concat(F.lit("."), F.substring_index("mime_type", "/", -1)), day).alias("storage_path"),
        "mime_type", F.length("content").cast("long").alias("file_size"), F.lit(SOURCE).alias("source_type"), "source_url", caption.alias("caption"),
        F.nullif("licence", F.lit("")).alias("licence"), F.lit(False).alias("is_deidentified"), F.lit("completed").alias("status"), "content", day.alias("day"),
    )
    made.dropDuplicates(["image_id"]).write.mode("append").partitionBy("day").parquet(f"{store}/figures")
    return told, scanned.get


def from_folder(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """url and content of the files below a folder that is laid out like the archive."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.substring_index("path", folder.rstrip("/").split("://")[-1] + "/", -1)
    return found.select(F.concat(F.lit(archive + "/"), inner).alias("url"), "content")
