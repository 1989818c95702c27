"""Abstracts from large files of citation markup, as a data source whose partitions are ranges of bytes.

A range owns the records whose opening tag begins in it and reads on to the end of its last one, so any split gives
the same rows. A record that isn't closed before the next one opens, or that can't be parsed, is a row with an error.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lectern.operators import metadata

OPEN, CLOSE = re.compile(rb"<PubmedArticle[\s>]"), b"</PubmedArticle>"
#: Bytes read at once, and of one partition, about.
BLOCK, SPLIT = 1 << 20, 64 << 20
SCHEMA = "pmid string, title string, abstract string, authors array<string>, error string"

# The least length of an abstract, the authors that are named, the content's template and the names.
LEAST_ABSTRACT, AUTHORS, SOURCE = 100, 3, "statpearls"
CONTENT = "\n%s\n\nAuthors: %s\nSource: StatPearls / PubMed (PMID: %s)\nType: Peer-reviewed medical reference article\n\n%s\n"


def chunks(file: Any, begin: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes, bool]]:
    """Place, bytes and whether it is closed of each record that opens in [begin, end) of a seekable file."""
    file.seek(begin)
    held, at, over = b"", begin, False  # what is held begins at this place

    def more() -> bool:
        nonlocal held, over
        got = b"" if over else file.read(block)
        over = not got
        held += got
        return not over

    while True:
        found = OPEN.search(held)
        if found is None:
            if at + len(held) >= end + 32 or not more():
                return
            # an opening tag may have begun in the last bytes
            cut = max(0, len(held) - block - 32)
            held, at = held[cut:], at + cut
            continue
        start, place = found.start(), at + found.start()
        if place >= end:
            return
        seen = found.end()
        while True:
            close, other = held.find(CLOSE, seen), OPEN.search(held, seen)
            if other is not None and (close < 0 or other.start() < close):
                stop, closed = other.start(), False
                break
            if close >= 0:
                stop, closed = close + len(CLOSE), True
                break
            seen = max(found.end(), len(held) - 32)
            if not more():
                stop, closed = len(held), False
                break
        yield place, held[start:stop], closed
        held, at = held[stop:], at + stop


def _prose(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def record(markup: bytes, closed: bool = True) -> tuple:
    """The row of one record."""
    try:
        if not closed:
            raise ET.ParseError("the record isn't closed")
        root = ET.fromstring(markup)
    except ET.ParseError as e:
        return None, None, None, None, str(e)
    parts = [(p.get("Label"), _prose(p)) for p in root.findall(".//Article/Abstract/AbstractText")]
    people = [" ".join(filter(None, (_prose(a.find("LastName")), _prose(a.find("Initials"))))) or _prose(a.find("CollectiveName")) for a in root.findall(".//Article/AuthorList/Author")]
    abstract = " ".join(f"{label}: {text}" if label else text for label, text in parts if text)
    return _prose(root.find(".//MedlineCitation/PMID")), _prose(root.find(".//Article/ArticleTitle")) or "Untitled", abstract, [p for p in people if p], None


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class PubmedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        """Ranges of all files of the path: only names and sizes are read here."""
        store, inner = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(inner)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, b, min(b + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for b in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            for _, markup, closed in chunks(file, partition.begin, partition.end):
                yield record(markup, closed)


class PubmedSource(DataSource):
    """spark.read.format("pubmed_xml").option("path", ...): a file or a folder; split: bytes of a partition, about."""

    @classmethod
    def name(cls) -> str:
        return "pubmed_xml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PubmedReader:
        return PubmedReader(self.options)


def load(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(PubmedSource)
    return spark.read.format("pubmed_xml").option("path", path).option("split", split).load()


def documents(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The records as documents to ingest: those with enough of an abstract whose title isn't stored (title, source_type) yet, each title once."""
    named = F.array_join(F.slice("authors", 1, AUTHORS), ", ")
    rows = records.filter(F.col("error").isNull() & (F.length("abstract") >= LEAST_ABSTRACT))
    made = rows.select(
        "pmid",
        "title",
        F.concat(F.lit("statpearls_"), "pmid", F.lit(".txt")).alias("filename"),
        F.lit(SOURCE).alias("source_type"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("source_url"),
        F.concat(F.lit("StatPearls article by "), named, F.lit(". PMID: "), "pmid").alias("description"),
        F.format_string(CONTENT, "title", named, "pmid", "abstract").alias("text"),
    )
    # of records with one title the least number stays
    first = made.groupBy("title").agg(F.min("pmid").alias("pmid"))
    once = made.join(first, ["title", "pmid"], "left_semi").dropDuplicates(["title", "pmid"])
    return once if stored is None else metadata.missing(once, stored, ["title", "source_type"])
