"""What the corpus operators share: reading, joins that split hot keys, Arrow maps."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import materialise, new_path, remove, shared_dir

__all__ = ["ARROW_ROWS", "HOT", "arrow_map", "fresh", "join_facts", "materialise", "new_path", "null_as_empty", "read_table", "remove", "setting", "shared_dir"]

#: A key is hot when it holds over one in HOT rows, so at most HOT keys are.
HOT = 512

#: Rows in an Arrow batch handed to Python. Texts are long, so batches are short.
ARROW_ROWS = 512

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, spread: list[str | Column], how: str = "inner") -> DataFrame:
    """rows joined by key with facts, which hold one row for each key and in `size` how many of the `total` rows have it.

    The rows of a hot key are dealt out over many tasks by a hash of the columns `spread`, and its facts are repeated for
    each part. Only the list of hot keys is broadcast, HOT at most. facts are read twice, so they should be written before.
    """
    share = max(1, total // HOT)
    parts = F.ceil(F.col(size) / share)
    hot = facts.filter(F.col(size) > share).select(key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("__parts")))).drop("__parts")
    each = facts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))).drop(size)
    return dealt.join(each, [key, "__part"], how).drop("__part")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):  # noqa: ANN201
    """A session setting for the time of the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow batch by batch with short batches; fn may return None for no rows.

    The length of batches is a session setting that counts when the plan runs, so it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def null_as_empty(values: pa.Array) -> list[str]:
    return [v if v is not None else "" for v in values.to_pylist()]
