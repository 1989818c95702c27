"""Files as rows: by extension to text, without any parser's library where the standard one suffices."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that are taken and how each is read.
PARSERS = {"txt": "text", "md": "text", "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}

MOST_BYTES = 50 << 20


class Unreadable(ValueError):
    """The file holds no text that can be read."""


def read_text(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def read_docx(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ` | `."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{word}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise Unreadable(f"no DOCX file: {e}") from e
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{word}t")).strip()
    found = [text_of(p) for p in body if p.tag == f"{word}p"]
    for row in (r for t in body if t.tag == f"{word}tbl" for r in t.iter(f"{word}tr")):
        found.append(" | ".join(filter(None, ("\n".join(filter(None, map(text_of, c.iter(f"{word}p")))) for c in row.iter(f"{word}tc")))))
    if not any(found):
        raise Unreadable("the DOCX file holds no text")
    return "\n\n".join(filter(None, found))


def read_pdf(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unreadable("reading PDF files needs pypdf") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages]
    if not any(pages):
        raise Unreadable("the PDF file holds no text")
    return "\n\n".join(filter(None, pages))


def read_image(content: bytes) -> str:
    raise Unreadable("no text recognition is installed")


READERS: dict[str, Callable[[bytes], str]] = {"text": read_text, "docx": read_docx, "pdf": read_pdf, "image": read_image}


def parse(content: bytes, extension: str) -> str:
    kind = PARSERS.get(extension.lower().lstrip("."))
    if kind is None:
        raise Unreadable(f"files of type {extension} aren't taken")
    return READERS[kind](content)


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, extension, size, text, error of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), "content")

    @F.pandas_udf("struct<text:string,error:string>")
    def run(contents: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        out = []
        for content, extension in zip(contents, extensions, strict=True):
            try:
                if len(content) > MOST_BYTES or not content:
                    raise Unreadable("empty, or too large")
                out.append((parse(content, extension), None))
            except Unreadable as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["text", "error"])

    return rows.withColumn("parsed", run("content", "extension")).select("path", "filename", "extension", "size", "parsed.text", "parsed.error")


def extensions_of(setting: str) -> list[str]:
    """A JSON array or a comma list of extensions, each with a dot and in lower case."""
    return ["." + x.strip().strip('"').lower().lstrip(".") for x in re.sub(r"[\[\]]", "", setting).split(",") if x.strip().strip('"')]
