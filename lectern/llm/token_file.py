"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file (one for each partition, in ascending doc_id order) holds

    head    8 bytes magic, 32 bytes SHA-256 of the dictionary, 8 bytes width of an id in bytes
    frames  each document's ids, little-endian, compressed by itself with the dictionary
    index   for each document: doc_id, null flag, place of its frame, its size, its ids (<qBQIQ)
    tail    place of the index, number of documents, 8 bytes magic (<QQ8s)

so that one short document is read with the tail, its index entry and its frame alone. The dictionary lies
beside the files under its hash; a reader with another one is refused. It is trained on the serialized ids
of a bounded sample: SAMPLE_DOCS documents of the least hash of doc_id (of one doc_id the least text), whole or, if longer than
SAMPLE_CHARS, so much of them from a hashed place on. That is some hundred times the dictionary's size, which doesn't
grow with the data; the ids that are written are always those of whole texts.

Tasks write under a name of their own attempt, through the file system that the shared folder's URI names; only
names that a finished task reported enter the manifest, so lost executors and repeated attempts do no harm.

Nulls: a null text is empty (only the end id); a null doc_id comes first. Rows of one doc_id are ordered by
a hash of their text; repeated rows are all written; an empty table writes no file; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import ARROW_ROWS, arrow_map, materialise, new_path
from lectern.llm.tokens import default_vocabulary, encoder

MAGIC = b"LECTOK01"
HEAD, ENTRY, TAIL = struct.Struct("<8s32sQ"), struct.Struct("<qBQIQ"), struct.Struct("<QQ8s")
END_ID, LEVEL = 2, 3
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 8192, 65_536

MANIFEST = "shard long, path string, docs long, tokens long"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few to train on serve as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def compression_dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


class Writer:
    def __init__(self, stream, dictionary: bytes, width: int = 2):  # noqa: ANN001
        self.stream, self.index, self.at = stream, [], HEAD.size
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=compression_dictionary(dictionary), write_content_size=True)
        stream.write(HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.width = width

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.stream.write(frame)
        self.index.append(ENTRY.pack(doc_id or 0, doc_id is None, self.at, len(frame), len(ids) // self.width))
        self.at += len(frame)

    def finish(self) -> None:
        self.stream.write(b"".join(self.index))
        self.stream.write(TAIL.pack(self.at, len(self.index), MAGIC))


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str, dictionary: bytes):
        fs, inner = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        magic, digest, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        self.index_at, self.docs, end = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no token file, or not a whole one")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=compression_dictionary(dictionary))

    def entry(self, i: int) -> tuple[int | None, int, int, int]:
        doc_id, null, at, size, n = ENTRY.unpack(self.file.read_at(ENTRY.size, self.index_at + i * ENTRY.size))
        return None if null else doc_id, at, size, n

    def ids(self, i: int) -> np.ndarray:
        _, at, size, n = self.entry(i)
        return self._ids(self.file.read_at(size, at), n)

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")[:n]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; index and frames are read in blocks."""
        block = 4096
        for first in range(0, self.docs, block):
            count = min(block, self.docs - first)
            raw = self.file.read_at(count * ENTRY.size, self.index_at + first * ENTRY.size)
            entries = list(ENTRY.iter_unpack(raw))
            i = 0
            while i < count:
                j, size = i, 0
                while j < count and (j == i or size + entries[j][3] <= 4 << 20):
                    size += entries[j][3]
                    j += 1
                frames = self.file.read_at(size, entries[i][2])
                for doc_id, null, at, length, n in entries[i:j]:
                    lo = at - entries[i][2]
                    yield (None if null else doc_id), self._ids(frames[lo : lo + length], n)
                i = j


def sample_ids(docs: DataFrame, vocabulary: str) -> list[bytes]:
    """Serialized ids of a bounded sample, chosen by a hash of doc_id."""
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    texts = docs.select("doc_id", F.substr(text, start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    run = lambda b: pa.RecordBatch.from_arrays([pa.array(encoder(vocabulary).encode(b.column(0).to_pylist()), pa.binary())], names=["ids"])
    return sorted(bytes(r[0]) for r in arrow_map(texts.select("text"), run, "ids binary").collect())


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Writes docs as token files into folder; the manifest (MANIFEST) and the dictionary's path."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    dictionary = train_dictionary(sample_ids(docs, vocabulary))
    fs, inner = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)
    dictionary_path = f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.zdict"
    with fs.open_output_stream(f"{inner}/{hashlib.sha256(dictionary).hexdigest()}.zdict", compression=None) as f:
        f.write(dictionary)
    end = np.asarray([end_id], "<u2").tobytes()
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc, stream, tokens = TaskContext.get(), encoder(vocabulary), None, 0
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex[:8]}.tokens"
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                task_fs, task_folder = pa.fs.FileSystem.from_uri(folder)
                stream = task_fs.open_output_stream(f"{task_folder}/{name}", compression=None)
                writer = Writer(stream, shared.value)
            texts = [t if t is not None else "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                writer.add(doc_id, ids + end)
                tokens += len(ids) // 2 + 1
        if stream is not None:
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.index)], pa.int64()), pa.array([tokens], pa.int64())],
                names=["shard", "path", "docs", "tokens"],
            )

    # equal rows may go to several files
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, MANIFEST), "manifest"), dictionary_path


def read(manifest: DataFrame, dictionary_path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files."""
    files = manifest.count()
    # one row for each file
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("before")).repartition(max(1, files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pa.fs.FileSystem.from_uri(dictionary_path)
        with fs.open_input_file(inner) as f:
            dictionary = f.read()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for doc_id, ids in Reader(path, dictionary):
                    held.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(held) == 8192:
                        yield _table(held)
                        held = []
                if held:
                    yield _table(held)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes docs and reads the files back."""
    return read(*write(docs, new_path(spark, "tokens")))
