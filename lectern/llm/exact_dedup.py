"""Exact deduplication as a stateful stream, native throughout.

A file stream folds every row into keyed state that never expires and lives on disk (RocksDB, with its
snapshots in the shared folder): the digest of the normalised text is the key, the value holds the stable
identifier and the content locator (file and row) of the row that stays, and the number of rows. A digest
that more than one row hit is only a candidate: the full normalised bytes of its rows are compared with
those of the row that stays, and rows that differ are grouped anew by their bytes.

Normalising deletes blank and the control characters 9 to 13. Of equal texts the row with the most code
points stays, then the smallest doc_id (null last), then the row first by locator. A null text counts
as empty; repeated rows are copies like others and only one of them stays; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import join_facts, materialise, new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LEAST_ID = -(2**63)

#: Input that one micro-batch takes at most.
BATCH_BYTES = 64 << 30


def normalised(text: Column) -> Column:
    # replace searches bytes; translate would look every character up
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(rows: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    """Of each row: its digest and what decides whether it stays, larger first."""
    return rows.select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.struct(
            F.length(F.coalesce("text", F.lit(""))).alias("chars"),
            # the least long has no negative
            (F.col("doc_id") == LEAST_ID).alias("least"),
            F.try_subtract(F.lit(0), "doc_id").alias("neg_id"),
            F.col("_metadata.file_path").alias("file"),
            (-F.col("_metadata.row_index")).alias("neg_row"),
        ).alias("rank"),
        *more,
    )


def fold(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """digest, best (rank of the row that stays), group_size, from the stream over the Parquet files at path.

    With the checkpoint of an earlier run only new files are read, into the state that the run left.
    """
    checkpoint = checkpoint or new_path(spark, "dedup-state")
    states = f"{checkpoint}/states"
    # map types, variants and the like in further columns don't matter: only two columns are read
    fields = {f.name: f for f in spark.read.parquet(path).schema.fields}
    schema = T.StructType([fields["doc_id"], fields["text"]])
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a file stream watches folders
        rows = source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        rows = source.parquet(path)
    groups = _keyed(rows, digest).groupBy("digest").agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{states}/batch={number:09d}")

    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # else every store reserves 4 MB for its manifest
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = groups.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        out = spark.read.option("basePath", states).parquet(states)
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        kinds = _keyed(spark.read.parquet(path).limit(0), digest).dtypes
        return spark.createDataFrame([], f"digest string, best {dict(kinds)['rank']}, group_size long")
    batches = [r[0] for r in out.select("batch").distinct().limit(2).collect()]
    if len(batches) < 2:
        return out.drop("batch")
    # a digest is told again by every batch that met it; the last has the whole
    return out.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("last")).select("digest", "last.best", "last.group_size")


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet table at path."""
    groups = fold(spark, path, digest, checkpoint, batch_bytes)
    table = spark.read.parquet(path)
    n = table.count()
    by_row = ["rank"]
    # full bytes on hits
    hits = groups.filter("group_size > 1")
    members = materialise(join_facts(_keyed(table, digest, F.col("doc_id"), normalised(F.col("text")).alias("norm")), hits.withColumn("n", F.col("group_size")), "digest", "n", n, by_row), "dedup-hits")
    kept = members.filter("rank = best").select("digest", F.col("norm").alias("keep_norm"), F.col("group_size").alias("n"))
    clashing = join_facts(members.select("digest", "rank", "norm"), kept, "digest", "n", n, by_row).filter("norm != keep_norm")
    clashing = materialise(clashing.groupBy("digest").agg(F.count("*").alias("n")).select("digest"), "dedup-clashes")
    rows = _keyed(table, digest, F.col("doc_id"), sha256(normalised(F.col("text"))).alias("text_sha256"))
    sound = groups.withColumn("n", F.col("group_size")).join(clashing, "digest", "left_anti")
    plain = join_facts(rows, sound, "digest", "n", n, by_row)
    # rows of different texts under one digest: by their bytes
    apart = members.drop("best", "group_size").join(clashing, "digest", "left_semi")
    again = apart.groupBy("digest", "norm").agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
    apart = apart.join(again, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm")))
    columns = ["doc_id", F.when(F.col("best.least"), F.lit(LEAST_ID)).otherwise(-F.col("best.neg_id")).alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"), "text_sha256"]
    return plain.select(*columns).unionByName(apart.select(*columns))
