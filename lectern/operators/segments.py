"""An inverted index that follows ingestion: segments of postings, tombstones, and statistics kept up to date.

A change writes one segment: the postings of the chunks that are new, a tombstone for every document that was replaced or
deleted, and what both change in the frequencies and in the number and length of chunks. A posting is dead when a later segment holds its
document's tombstone. Texts that didn't change are never read; of the old postings only those of changed documents are. When segments become
many they are merged into one without the dead. A change of the same number leaves the same segment, so a batch may be run again.

The folder: postings, tombstones, frequencies and sizes, partitioned by segment, and a manifest for each version,
which lists the segments that are in force and counts when it is written whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lexical
from lectern.storage import remove

#: Segments in force before they are merged.
MOST = 8
#: Changed documents (16 bytes each) that are sent to all tasks at most.
BROADCAST = 2_000_000
POSTINGS = "term string, id string, document_id long, tf long, dl int, lead boolean, segment long"
TABLES = {"postings": POSTINGS, "tombstones": "document_id long, segment long", "frequencies": "term string, df long, segment long", "sizes": "n long, words long, segment long"}


class SegmentIndex(lexical.Index):
    """The live postings, with frequencies and sizes summed from the segments' changes."""

    def __init__(self, postings: DataFrame, frequencies: DataFrame, sizes: DataFrame):
        super().__init__(postings)
        self._frequencies, self._sizes = frequencies, sizes

    @property
    def frequencies(self) -> DataFrame:
        return self._frequencies.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def size(self) -> DataFrame:
        return self._sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))


class Store:
    """The index in a folder that all executors reach. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    # ---- versions ----

    def _files(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []

    def versions(self) -> list[int]:
        """The versions whose manifest is whole, ascending."""
        names = [n for n in self._files("manifest") if n.startswith("version=")]
        return sorted(int(n.partition("=")[2]) for n in names if "_SUCCESS" in self._files(f"manifest/{n}"))

    def segments(self, version: int | None = None) -> list[int]:
        """The segments in force at a version, by default the last."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        return sorted(r["segment"] for r in self.spark.read.schema("segment long").parquet(f"{self.path}/manifest/version={version}").collect()) if version in known else []

    def _commit(self, version: int, segments: list[int]) -> None:
        # at most MOST + 1 rows
        self.spark.createDataFrame([(s,) for s in segments], "segment long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _read(self, table: str, segments: list[int]) -> DataFrame:
        """The rows of a table's segments; partitions of others aren't listed as input."""
        if not segments:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}").filter(F.col("segment").isin(segments))

    def _few(self, keys: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """keys, sent to the postings if they (or the stored rows they come from) are few enough, so that no posting is shuffled."""
        return F.broadcast(keys) if (rows or keys).count() <= BROADCAST else keys

    def _live(self, segments: list[int]) -> DataFrame:
        # what the oldest segment replaced isn't in force any more
        told = self._read("tombstones", segments[1:])
        dead = self._few(told.groupBy("document_id").agg(F.max("segment").alias("until")), told)
        postings = self._read("postings", segments).join(dead, "document_id", "left")
        return postings.filter(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def index(self) -> SegmentIndex:
        """What is in force, for lexical.search and its kin."""
        own = self.segments()
        return SegmentIndex(self._live(own).select("term", "id", "tf", "dl", "lead"), self._read("frequencies", own), self._read("sizes", own))

    # ---- changes ----

    def _write(self, table: str, segment: int, rows: DataFrame) -> None:
        kinds = {f.split()[0]: f.split()[1] for f in TABLES[table].split(", ")}
        rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items() if c != "segment"]).write.mode("overwrite").parquet(f"{self.path}/{table}/segment={segment}")

    def apply(self, changes: DataFrame, number: int) -> None:
        """Takes a batch of changes: rows (document_id, id, text) are a document's chunks from now on, rows with a null id delete it.

        Numbers ascend from 0; one that was applied before changes nothing. A document that is deleted and has chunks in one batch is replaced.
        """
        segment = 2 * number
        known = self.versions()
        if any(v >= segment for v in known):
            return
        before = self.segments(known[-1]) if known else []
        changed = changes.select("document_id").filter(F.col("document_id").isNotNull()).distinct()
        self._write("tombstones", segment, changed)
        chunks = changes.filter("id IS NOT NULL AND document_id IS NOT NULL").select(F.struct("document_id", F.col("id").cast("string").alias("id")).alias("key"), "text")
        made = lexical.postings(chunks, "key").select("term", "id.id", "id.document_id", "tf", "dl", "lead")
        # each file by term: few terms are found in few pages of it, and no posting is shuffled
        self._write("postings", segment, made.sortWithinPartitions("term", "id"))
        new = self.spark.read.schema(POSTINGS.rpartition(",")[0]).parquet(f"{self.path}/postings/segment={segment}")
        marked = self.spark.read.schema("document_id long").parquet(f"{self.path}/tombstones/segment={segment}")
        old = self._live(before).join(self._few(marked), "document_id", "left_semi")
        both = new.select("term", "dl", "lead", F.lit(1).alias("sign")).unionByName(old.select("term", "dl", "lead", F.lit(-1).alias("sign")))
        self._write("frequencies", segment, both.groupBy("term").agg(F.sum("sign").alias("df")).filter("df <> 0"))
        self._write("sizes", segment, both.filter("lead").agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("words")))
        self._commit(segment, [*before, segment])
        if len(before) + 1 > self.most:
            self.merge()

    def merge(self) -> None:
        """One segment in place of all in force, without dead postings and their tombstones."""
        own = self.segments()
        if len(own) < 2:
            return
        segment = own[-1] // 2 * 2 + 1
        self._write("postings", segment, self._live(own).sortWithinPartitions("term", "id"))
        self._write("tombstones", segment, self.spark.createDataFrame([], "document_id long"))
        summed = self._read("frequencies", own).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        self._write("frequencies", segment, summed)
        self._write("sizes", segment, self._read("sizes", own).agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
        self._commit(segment, [segment])

    def vacuum(self) -> None:
        """Deletes segments and manifests that the last version doesn't name; readers of earlier ones must be done."""
        known, own = self.versions(), set(self.segments())
        for table in TABLES:
            for name in self._files(table):
                if name.startswith("segment=") and int(name.partition("=")[2]) not in own:
                    remove(self.spark, f"{self.path}/{table}/{name}")
        for version in known[:-1]:
            remove(self.spark, f"{self.path}/manifest/version={version}")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that a stream of changes holds now; the checkpoint remembers how far it came."""
        stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
