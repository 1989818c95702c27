"""Resumable ingestion: new rows of a stream become points, what is stored already is skipped, outcomes are counted.

The stream's checkpoint remembers what was read, so a run that was cut off goes on where it stopped. A batch
writes its tables under its own number and overwrites what an attempt before may have left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import strip
from lectern.operators.chunking import LEAST_TEXT
from lectern.operators.vector import Embedder
from lectern.plans import ingest
from lectern.storage import materialise

#: What makes two documents the same.
KEYS = ["title", "source_type"]
OUTCOME = "document_id long, title string, source_type string, reason string, batch long"


def _stored(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """The rows that other batches wrote; none before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(schema).parquet(path).filter(F.col("batch") != number)


def told(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch with `reason` for each row; known: the KEYS that are stored.

    A reason that a row brings stays. Otherwise: skipped (its title and source are stored, or another row of the batch is taken for
    them), failed (too little text, or no document_id), completed. Of the rows that could be taken for one title and source that of the least document_id is.
    """
    given = F.col("reason") if "reason" in batch.columns else F.lit(None).cast("string")
    rows = materialise(batch.withColumns({"__row": F.monotonically_increasing_id(), "reason": given}), "top-up")
    enough = F.coalesce(F.length(strip(F.col("text"))) >= LEAST_TEXT, F.lit(False)) & F.col("document_id").isNotNull()
    able = rows.filter(F.col("reason").isNull() & enough)
    first = able.groupBy(*KEYS).agg(F.min(F.struct("document_id", "__row"))["__row"].alias("__row"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEYS]
    stored = rows.select("__row", *KEYS).alias("d").join(known.alias("k"), same, "left_semi").select("__row", F.lit(True).alias("__stored"))
    taken = first.select("__row", F.lit(True).alias("__taken"))
    marked = rows.join(stored, "__row", "left").join(taken, "__row", "left")
    reason = F.when(F.col("__stored"), "skipped").when(F.col("__taken"), "completed").when(~enough, "failed").otherwise("skipped")
    return marked.withColumn("reason", F.coalesce("reason", reason)).drop("__row", "__stored", "__taken")


def run(stream: DataFrame, store: str, embedder: Embedder | None = None, also: list[str] | None = None) -> None:
    """Takes all rows (document_id, title, filename, source_type, text, perhaps reason) of a stream into store/points and store/outcomes; also: further columns of outcomes."""
    spark = stream.sparkSession
    points, outcomes_at = f"{store}/points", f"{store}/outcomes"

    def take(batch: DataFrame, number: int) -> None:
        known = _stored(spark, outcomes_at, number, StructType.fromDDL(OUTCOME)).filter("reason = 'completed'").select(*KEYS).distinct()
        rows = materialise(told(batch, known), "top-up-told")
        fresh = rows.filter("reason = 'completed'").drop("reason", *(also or []))
        ingest.points(fresh, embedder).write.mode("overwrite").parquet(f"{points}/batch={number}")
        rows.select("document_id", *KEYS, *(also or []), "reason").write.mode("overwrite").parquet(f"{outcomes_at}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{store}/log").trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, store: str, also: str = "") -> DataFrame:
    """The number of rows by reason, and by further columns (as in a schema) that the outcomes hold."""
    rows = _stored(spark, f"{store}/outcomes", -1, StructType.fromDDL(", ".join(filter(None, [OUTCOME, also]))))
    return rows.groupBy(*[f.split()[0] for f in also.split(",") if f], "reason").agg(F.count("*").alias("n"))


def top_up(spark: SparkSession, incoming: str, store: str, schema: StructType, embedder: Embedder | None = None, files: int | None = None) -> DataFrame:
    """Takes all new files of `incoming` (document_id, title, filename, source_type, text) into store/points; the outcomes by reason.

    files: files of one batch at most.
    """
    source = spark.readStream.schema(schema)
    if files is not None:
        source = source.option("maxFilesPerTrigger", files)
    run(source.parquet(incoming), store, embedder)
    return outcomes(spark, store)
