"""Stored pages of articles as a stream with offsets of its own: how far each topic has been taken.

The folder holds a folder for each topic with pages in the order of their names; a file is one page, or a bundle of many (Parquet with a column
`value`, a page a row), as a file for each page costs more than what is in it. An offset names each topic's
last file; a batch takes what came after, some files a task, and a batch that is run again reads the same pages. A page that can't be read or
parsed is a row with a reason, as is an article that ingestion doesn't take: one bad topic stops no other.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lectern.operators.vector import Embedder
from lectern.sources.markup import local, record
from lectern.streaming import topup

SCHEMA = "topic string, page string, pos int, title string, content string, pmcid string, pmid string, doi string, journal string, year string, reason string"
SOURCE = "pmc_open_access"
NO_ACCESS, UNREADABLE = "no access", "unreadable"


#: Files and bytes of one task at most.
TASK_PAGES, TASK_BYTES = 256, 64 << 20
#: How the name of a bundle ends, pages of one that `store` writes, and how much larger its markup is taken to be than the file.
BUNDLE, BUNDLE_PAGES, PACKED = ".parquet", 256, 4


@dataclass
class Page:
    topic: str
    name: str
    path: str
    size: int

    @property
    def weight(self) -> int:
        return self.size * PACKED if self.name.endswith(BUNDLE) else self.size


@dataclass
class Pages(InputPartition):
    own: list[Page]


def grouped(found: list[Page]) -> list[Pages]:
    """The files in order, as many a task as its limits allow."""
    out: list[Pages] = []
    held = 0
    for p in found:
        if not out or len(out[-1].own) == TASK_PAGES or held + p.weight > TASK_BYTES:
            out.append(Pages([]))
            held = 0
        out[-1].own.append(p)
        held += p.weight
    return out


def store(pages: DataFrame, path: str) -> None:
    """Writes pages (topic, value) as bundles in a folder for each topic."""
    pages.select("topic", "value").write.option("maxRecordsPerFile", BUNDLE_PAGES).partitionBy("topic").parquet(path)


def markups(store: fs.FileSystem, page: Page) -> Iterator[tuple[Page, bytes | str]]:
    """The pages of a file with their markup; empty markup stands for what can't be read, as it does for a file taken away since it was listed."""
    try:
        if not page.name.endswith(BUNDLE):
            with store.open_input_stream(page.path) as file:
                yield page, file.read()
            return
        with store.open_input_file(page.path) as file:
            n = 0
            for batch in pq.ParquetFile(file).iter_batches(16, columns=["value"]):
                for value in batch.column(0).to_pylist():
                    yield replace(page, name=f"{page.name}/{n}"), value or b""
                    n += 1
    except (FileNotFoundError, pa.ArrowInvalid):
        yield page, b""


def rows_of(page: Page, markup: bytes | str) -> Iterator[tuple]:
    """A row for each article of a page; one row with a reason for a page that isn't markup."""
    none = (None,) * 7
    try:
        root = ET.fromstring(markup)
    except ET.ParseError:
        yield page.topic, page.name, 0, *none, UNREADABLE
        return
    found = [e for e in root.iter() if local(e.tag) == "article"]
    for i, node in enumerate(found):
        made = record(node)
        yield page.topic, page.name, i, *([made[k] for k in ("title", "content", "pmcid", "pmid", "doi", "journal", "year")] if made else none), None if made else NO_ACCESS


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _topics(self) -> dict[str, list[fs.FileInfo]]:
        """The pages of every topic, in order: names alone are read."""
        store, inner = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[fs.FileInfo]] = {}
        for info in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                found.setdefault(info.path.rsplit("/", 2)[-2], []).append(info)
        return {t: sorted(pages, key=lambda p: p.base_name) for t, pages in sorted(found.items())}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {t: pages[-1].base_name for t, pages in self._topics().items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return grouped([Page(t, p.base_name, p.path, p.size) for t, pages in self._topics().items() for p in pages if t in end and start.get(t, "") < p.base_name <= end[t]])

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for file in partition.own:
            for page, markup in markups(store, file):
                yield from rows_of(page, markup)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """spark.readStream.format("article_pages").option("path", ...)."""

    @classmethod
    def name(cls) -> str:
        return "article_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PageReader:  # noqa: N802
        return PageReader(self.options)


def pages(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.readStream.format("article_pages").option("path", path).load()


def documents(rows: DataFrame) -> DataFrame:
    """The rows as what top-up takes: an article's number tells its name, its title and source what is the same."""
    number = F.coalesce(F.nullif("pmcid", F.lit("")), F.nullif("pmid", F.lit("")), F.lit("unknown"))
    return rows.select(
        F.xxhash64("topic", "page", "pos").alias("document_id"),
        "title",
        F.concat(F.lit("pmc_"), number, F.lit(".txt")).alias("filename"),
        F.lit(SOURCE).alias("source_type"),
        F.col("content").alias("text"),
        "reason",
        "topic",
    )


def fetch(spark: SparkSession, path: str, store: str, embedder: Embedder | None = None) -> DataFrame:
    """Takes all new pages of the folder into store/points; the outcomes by topic and reason, of all runs so far."""
    topup.run(documents(pages(spark, path)), store, embedder, also=["topic"])
    return topup.outcomes(spark, store, "topic string")
