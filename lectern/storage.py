"""Tables written to the folder that driver and executors share: lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside the one that spark.checkpoint.dir names.

    Driver and executors both reach it. Only in local mode may the setting be absent: a temporary folder of this
    machine is taken then. The folder goes when the driver exits.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _dirs:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        path = f"{base.rstrip('/')}/lectern-{sc.applicationId}"
        _dirs[sc.applicationId] = path
        atexit.register(remove, spark, path)
    return _dirs[sc.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later step reads."""
    try:
        delete(spark, path)
    except Exception:  # the JVM may be gone at exit
        pass


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file; one that isn't there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
