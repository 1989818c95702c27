"""Listing, counting and changing rows of the metadata tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, **wanted: Any) -> DataFrame:
    """Rows that equal every given value; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def visible(rows: DataFrame, owner: Any, column: str = "user_id") -> DataFrame:
    """The owner's rows and those that belong to nobody."""
    return rows.filter((F.col(column) == owner) | F.col(column).isNull())


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page of rows; the order should end in a unique key."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def chunks_of(points: DataFrame, document: Any = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A slice of each document's chunks, or of one document's, in order of chunk_index (null first)."""
    if offset < 0 or limit < 1:
        raise ValueError("a slice begins at 0 or later and holds 1 chunk or more")
    own = matching(points, document_id=document)
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return own.withColumn("__n", F.row_number().over(order)).filter(F.col("__n").between(offset + 1, offset + limit)).drop("__n")


def status_counts(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row: total and the number of rows in each status, in one pass."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def counts_by(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """The number of rows of each group; nulls are a group."""
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, rounded; 0 without a whole."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def missing(new: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """New rows whose keys aren't stored yet, each key once."""
    return new.dropDuplicates(on).join(stored.select(*on).distinct(), on, "left_anti")


def review_rates(reports: DataFrame) -> DataFrame:
    """status, edited -> totals with approval and edit rates.

    edit_rate counts edits of all rows over reviewed ones, as the service publishes it; edit_rate_reviewed only those of reviewed rows.
    """
    done = F.col("status").isin("approved", "rejected")
    counts = reports.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("edited")).alias("edited"),
        F.count_if(F.col("edited") & done).alias("edited_reviewed"),
    )
    reviewed = F.col("approved") + F.col("rejected")
    return counts.select(
        "total", "approved", "rejected", "edited",
        rate(F.col("edited"), reviewed).alias("edit_rate"),
        rate(F.col("edited_reviewed"), reviewed).alias("edit_rate_reviewed"),
        rate(F.col("approved"), reviewed).alias("approval_rate"),
    )


def merge(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the non-null values of changes, by key; unknown keys change nothing."""
    changed = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias("__new_" + c) for c in changed])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce("__new_" + c, c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def replace_documents(stored: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """An upsert by document: all stored rows of the new rows' documents give way."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_vectors(stored: DataFrame, new: DataFrame, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """stored with the vectors of new, by key; everything else stays, unknown keys change nothing. A vector of another length is an error."""
    given = new.select(key, F.col(vector).alias("__vector"))
    same = F.size("__vector") == F.size(vector)
    checked = F.when(F.col("__vector").isNull(), F.col(vector)).when(same, F.col("__vector")).otherwise(F.raise_error(F.concat(F.lit("another length of vector for "), F.col(key).cast("string"))))
    return stored.join(given, key, "left").select(*[checked.alias(c) if c == vector else F.col(c) for c in stored.columns])


def delete(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """rows without those of the keys in gone: a document's metadata, chunks and figures alike."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


#: States of a background job, in the order in which they follow each other.
STATES = ["pending", "processing", "completed", "failed"]


def next_status(now: Column, told: Column) -> Column:
    """The state after a report: jobs go forward only, and a finished one stays as it is."""
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in STATES]), c)
    return F.when(now.isin("completed", "failed") | (place(told) <= place(now)), now).otherwise(told)


def accepted(uploads: DataFrame, extensions: list[str], most: int) -> DataFrame:
    """uploads (filename, size) with status pending, or rejected and the reason: an extension that isn't taken, no content, or more than `most` bytes."""
    extension = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"(\.[^.]+)$", 1))
    reason = (
        F.when(~extension.isin(*extensions), F.concat(F.lit("files of type "), F.when(extension == "", F.lit("?")).otherwise(extension), F.lit(" aren't taken")))
        .when(F.coalesce("size", F.lit(0)) == 0, F.lit("the file is empty"))
        .when(F.col("size") > most, F.lit(f"the file is larger than {most} bytes"))
    )
    return uploads.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "pending").otherwise("rejected"))


def unlink(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children keep their rows when parents go; their link becomes null."""
    gone = deleted.select(F.col(key).alias("__gone")).distinct()
    joined = children.join(gone, F.col(key) == F.col("__gone"), "left")
    return joined.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def review(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (report_id, status, edited_text, reviewer): approved rows change only when set back to draft in the same change."""
    c = changes.select("report_id", F.col("status").alias("__status"), F.col("edited_text").alias("__text"), F.col("reviewer").alias("__by"))
    joined = reports.join(c, "report_id", "left")
    allowed = (F.col("status") != "approved") | (F.col("__status") == "draft")
    decided = F.col("__status").isin("approved", "rejected")
    values = {
        "status": F.when(allowed, F.coalesce("__status", "status")).otherwise(F.col("status")),
        "edited_text": F.when(allowed, F.coalesce("__text", "edited_text")).otherwise(F.col("edited_text")),
        "reviewer": F.when(allowed & decided, F.col("__by")).when(allowed & (F.col("__status") == "draft"), F.lit(None)).otherwise(F.col("reviewer")),
    }
    return joined.select(*[values[x].alias(x) if x in values else F.col(x) for x in reports.columns])
