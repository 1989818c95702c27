"""Where rows and files lie: tables in folders by source and day that change a folder at a time, and paths that stay inside a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import delete, exists, materialise


def relative_path(name: Column, suffix: Column, day: Column) -> Column:
    """`2026/08/11/name.png`: a folder for each day; relative, as roots move. The suffix with or without its dot, in lower case."""
    dotted = F.when(suffix.startswith("."), suffix).otherwise(F.concat(F.lit("."), suffix))
    return F.concat(F.date_format(day, "yyyy/MM/dd/"), name, F.lower(dotted))


def thumbnail_path(path: Column) -> Column:
    """`a/b.png` -> `a/b.thumb.jpg`."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".thumb.jpg"))


def normal(path: Column) -> Column:
    """A relative path without `.`, `..` and doubled slashes; null if it leaves the root, is absolute or null."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")

    def step(at: Column, part: Column) -> Column:
        # below the root nothing is left to climb from: null stays null
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
        return F.when(at.isNull() | part.isin("", "."), at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))

    inside = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.coalesce(path.rlike(r"^([/\\]|[A-Za-z]:)"), F.lit(True)), F.array_join(inside, "/"))


def resolve(root: str, path: Column) -> Column:
    """The path below the root; one that leaves it is an error."""
    inner = normal(path)
    refused = F.raise_error(F.concat(F.lit("a path outside the root: "), F.coalesce(path, F.lit("null"))))
    return F.when(inner.isNull(), refused).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), inner))


class Table:
    """Rows of documents in a folder for each value of `by`; a change rewrites the folders of its documents alone.

    A folder is rewritten from a table in the shared folder, so a change that was cut off is made good by repeating it. One writer
    at a time. The names of the folders that a change concerns pass through the driver: they are at most those that its
    listing holds anyway, and those of the new rows. Values of `by` mustn't be null (they get the table's default folder, and are read back as null).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...] = ("source_type", "day"), key: str = "document_id") -> None:
        self.spark, self.path, self.schema, self.by, self.key = spark, path.rstrip("/"), schema, list(by), key

    def rows(self) -> DataFrame:
        """All rows; filters on `by` read their folders alone."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _of(self, keys: DataFrame) -> DataFrame:
        """The folders that hold rows of the keys: of stored rows only key and folder are read."""
        return self.rows().select(self.key, *self.by).join(keys, self.key, "left_semi").select(*self.by).distinct()

    def _in(self, folders: DataFrame) -> DataFrame:
        """The stored rows of some folders; the scan lists only folders whose every value of `by` occurs among them."""
        rows, named = self.rows(), folders.collect()
        for c in self.by:
            values = {r[c] for r in named}
            wanted = F.col(c).isin(*[F.lit(v) for v in values if v is not None])
            rows = rows.filter(wanted | F.col(c).isNull() if None in values else wanted)
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in self.by]
        return rows.alias("t").join(F.broadcast(folders.alias("f")), same, "left_semi")

    def _rewrite(self, folders: DataFrame, keys: DataFrame, new: DataFrame | None) -> None:
        folders = materialise(folders, "folders")
        left = self._in(folders).join(keys, self.key, "left_anti")
        columns = self.rows().columns
        told = materialise(left if new is None else left.select(*columns).unionByName(new.select(*columns)), "rewritten")
        told.repartition(*self.by, F.pmod(F.xxhash64(self.key), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)
        # a folder that lost its last row isn't overwritten by any
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in self.by]
        for row in folders.alias("f").join(told.select(*self.by).distinct().alias("t"), same, "left_anti").toLocalIterator():
            delete(self.spark, "/".join([self.path, *[f"{c}={self._name(row[c])}" for c in self.by]]))

    def _name(self, value: object) -> str:
        """A value as Spark names its folder."""
        if value is None:
            return "__HIVE_DEFAULT_PARTITION__"
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))

    def upsert(self, new: DataFrame) -> None:
        """All stored rows of the new rows' documents give way, in whatever folder they lie. Repeating it changes nothing; a null key is an error."""
        known = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"a row without {self.key}")))
        new = materialise(new.withColumn(self.key, known), "upsert")
        keys = new.select(self.key).distinct()
        self._rewrite(self._of(keys).unionByName(new.select(*self.by)).distinct(), keys, new)

    def delete(self, gone: DataFrame) -> None:
        """The rows of the keys in gone leave; unknown and null keys change nothing."""
        keys = materialise(gone.select(self.key).distinct(), "deleted")
        self._rewrite(self._of(keys), keys, None)

    def stats(self) -> DataFrame:
        """by, files, bytes of each folder, from the listing: no file is opened."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], ", ".join([f"{c} string" for c in self.by] + ["files long", "bytes long"]))
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path)
        names = [F.url_decode(F.replace(F.regexp_extract("path", rf"/{c}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias(c) for c in self.by]
        return listed.select("length", *names).groupBy(*self.by).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
