"""DICOM images as rows: a reader of tags, lengths and values for files whose pixels aren't compressed.

A file becomes one row: the middle frame windowed to 0..255 as bytes, the tags that say nothing about a person, and the study's
year. Data sets may have implicit or explicit value representations, either byte order, or be deflated; sequences
and elements of undefined length are passed over whatever they nest. A file that can't be read whole is a row with an error and no image: a
half-read file is never stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import imaging

# Fixed values of the published standard: the elements that are read, those of them that are binary integers, transfer syntaxes.
ELEMENTS = {
    "TransferSyntaxUID": (0x0002, 0x0010),
    "StudyDate": (0x0008, 0x0020),
    "Modality": (0x0008, 0x0060),
    "Manufacturer": (0x0008, 0x0070),
    "BodyPartExamined": (0x0018, 0x0015),
    "SliceThickness": (0x0018, 0x0050),
    "KVP": (0x0018, 0x0060),
    "PatientPosition": (0x0018, 0x5100),
    "ViewPosition": (0x0018, 0x5101),
    "SamplesPerPixel": (0x0028, 0x0002),
    "PhotometricInterpretation": (0x0028, 0x0004),
    "NumberOfFrames": (0x0028, 0x0008),
    "Rows": (0x0028, 0x0010),
    "Columns": (0x0028, 0x0011),
    "BitsAllocated": (0x0028, 0x0100),
    "BitsStored": (0x0028, 0x0101),
    "PixelRepresentation": (0x0028, 0x0103),
    "WindowCenter": (0x0028, 0x1050),
    "WindowWidth": (0x0028, 0x1051),
    "RescaleIntercept": (0x0028, 0x1052),
    "RescaleSlope": (0x0028, 0x1053),
    "PixelData": (0x7FE0, 0x0010),
}
SHORTS = {"SamplesPerPixel", "Rows", "Columns", "BitsAllocated", "BitsStored", "PixelRepresentation"}
LONG_HEADS = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)

UNDEFINED, MOST_BYTES = 0xFFFFFFFF, 512 << 20
NAMES = {tag: name for name, tag in ELEMENTS.items()}
IMAGE = "struct<rows:int,columns:int,frames:int,levels:binary,tags:map<string,string>,study_date:string,error:string>"
FIELDS = ["rows", "columns", "frames", "levels", "tags", "study_date", "error"]


class Malformed(ValueError):
    """The file is no image that can be read whole."""


def _head(data: memoryview, at: int, explicit: bool, order: str) -> tuple[tuple[int, int], bytes, int, int]:
    """Tag, value representation, length and place of the value of the element at this place."""
    if at + 8 > len(data):
        raise Malformed("the file ends within an element")
    tag = struct.unpack_from(order + "HH", data, at)
    if not explicit or tag[0] == 0xFFFE:
        return tag, b"", struct.unpack_from(order + "I", data, at + 4)[0], at + 8
    kind = bytes(data[at + 4 : at + 6])
    if kind not in LONG_HEADS:
        return tag, kind, struct.unpack_from(order + "H", data, at + 6)[0], at + 8
    if at + 12 > len(data):
        raise Malformed("the file ends within an element")
    return tag, kind, struct.unpack_from(order + "I", data, at + 8)[0], at + 12


def _after(data: memoryview, at: int, explicit: bool, order: str) -> int:
    """The place behind a value of undefined length that begins at this place; what it nests may be undefined in turn."""
    inside = [explicit]
    while inside:
        tag, kind, length, at = _head(data, at, inside[-1], order)
        if tag in (ITEM_END, SEQUENCE_END):
            inside.pop()
        elif length == UNDEFINED:
            # an unknown representation of undefined length is written implicitly
            inside.append(inside[-1] and kind != b"UN")
        else:
            at += length
        if at > len(data):
            raise Malformed("the file ends within a sequence")
    return at


def elements(content: bytes) -> tuple[dict[str, memoryview], str]:
    """The values of the known elements of the data set itself, by name, and the byte order."""
    data, at, syntax = memoryview(content), 0, ""
    if len(data) > 132 and data[128:132] == b"DICM":
        at = 132
        while at + 8 <= len(data) and struct.unpack_from("<H", data, at)[0] == 0x0002:
            tag, _, length, start = _head(data, at, True, "<")
            at = start + length
            if tag == ELEMENTS["TransferSyntaxUID"]:
                syntax = bytes(data[start:at]).decode("latin-1").strip(" \0")
    else:
        # without the mark: what stands where a representation would tells
        syntax = EXPLICIT if bytes(data[4:6]).isalpha() and bytes(data[4:6]).isupper() else IMPLICIT
    if syntax not in (IMPLICIT, EXPLICIT, BIG, DEFLATED):
        raise Malformed(f"pixels of transfer syntax {syntax or 'unknown'} can't be decoded")
    if syntax == DEFLATED:
        try:
            inflate = zlib.decompressobj(-15)
            data, at = memoryview(inflate.decompress(data[at:], MOST_BYTES)), 0
        except zlib.error as e:
            raise Malformed(f"the data set can't be inflated: {e}") from e
        if not inflate.eof:
            raise Malformed("the deflated data set is cut off, or too large")
    order, explicit, found = ">" if syntax == BIG else "<", syntax != IMPLICIT, {}
    while at < len(data):
        tag, kind, length, start = _head(data, at, explicit, order)
        if length == UNDEFINED:
            at = _after(data, start, explicit and kind != b"UN", order)
            continue
        at = start + length
        if at > len(data):
            raise Malformed("the file ends within an element")
        if tag in NAMES:
            found[NAMES[tag]] = data[start:at]
    return found, order


def _text(value: memoryview) -> str:
    return bytes(value).decode("latin-1").strip(" \0")


def _number(found: dict[str, memoryview], name: str) -> float | None:
    """The first of the numbers of a decimal string."""
    first = _text(found[name]).split("\\")[0].strip() if name in found else ""
    try:
        return float(first) if first else None
    except ValueError as e:
        raise Malformed(f"{name} is no number") from e


def levels(stored: np.ndarray, slope: float | None = None, intercept: float | None = None, center: float | None = None, width: float | None = None, photometric: str = "") -> np.ndarray:
    """Stored values as 0..255, by the rules of imaging.windowed and imaging.shown."""
    real = stored.astype(np.float64) * (slope or 1.0) + (intercept or 0.0)
    low, high = (center - width / 2, center + width / 2) if center is not None and width is not None and width > 0 else (real.min(), real.max())
    high = high if high > low else low + 1
    out = (np.clip((real - low) / (high - low), 0.0, 1.0) * 255).astype(np.uint8)
    return 255 - out if photometric == "MONOCHROME1" else out


def image(content: bytes) -> dict:
    """The fields of one file; Malformed if it can't be read whole."""
    found, order = elements(content)
    if "PixelData" not in found:
        raise Malformed("the file holds no pixels")
    short = lambda name, default=None: struct.unpack(order + "H", found[name])[0] if name in found and len(found[name]) == 2 else default
    rows, columns, bits, frames = short("Rows"), short("Columns"), short("BitsAllocated", 16), int(_number(found, "NumberOfFrames") or 1)
    if not rows or not columns or frames < 1 or bits not in (8, 16, 32):
        raise Malformed("the size of the image isn't told")
    if short("SamplesPerPixel", 1) != 1:
        raise Malformed("images of several samples a pixel aren't taken")
    size = rows * columns * bits // 8
    if len(found["PixelData"]) < frames * size:
        raise Malformed("there are fewer pixels than the image needs")
    kind = np.dtype(f"{order}{'i' if short('PixelRepresentation', 0) else 'u'}{bits // 8}")
    stored = np.frombuffer(found["PixelData"], kind, rows * columns, frames // 2 * size)
    photometric = _text(found.get("PhotometricInterpretation", memoryview(b"")))
    shown = levels(stored, *(_number(found, n) for n in ("RescaleSlope", "RescaleIntercept", "WindowCenter", "WindowWidth")), photometric)
    tags = {n: str(short(n)) if n in SHORTS else _text(found[n]) for n in imaging.TAGS if n in found}
    return {"rows": rows, "columns": columns, "frames": frames, "levels": shown.tobytes(), "tags": tags, "study_date": _text(found["StudyDate"]) if "StudyDate" in found else None, "error": None}


def images(files: DataFrame, content: str = "content") -> DataFrame:
    """files, without their content, with rows, columns, frames, levels (a byte for each pixel, row by row), metadata, study_year, error."""

    @F.pandas_udf(IMAGE)
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for x in contents:
            try:
                if x is None or len(x) > MOST_BYTES:
                    raise Malformed("empty, or too large")
                out.append(image(x))
            except (Malformed, struct.error) as e:
                out.append(dict.fromkeys(FIELDS) | {"error": str(e)})
        return pd.DataFrame(out, columns=FIELDS)

    own = [c for c in files.columns if c != content]
    read = files.select(*own, run(F.col(content)).alias("__image"))
    told = {c: F.col(f"__image.{c}") for c in ("rows", "columns", "frames", "levels")}
    return read.select(*own, *[x.alias(c) for c, x in told.items()], imaging.allowed(F.col("__image.tags")).alias("metadata"), imaging.study_year(F.col("__image.study_date")).alias("study_year"), F.col("__image.error").alias("error"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Every DICOM file below path, by its mark or extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")
    return images(files.filter(imaging.is_dicom(F.col("content"), F.col("path"))))


# ---- writing ----


def _element(tag: tuple[int, int], kind: bytes, value: bytes, explicit: bool, order: str, length: int | None = None) -> bytes:
    value += (b"\0" if kind in (b"UI", b"OB", b"OW") else b" ") * (len(value) % 2)
    head, n = struct.pack(order + "HH", *tag), len(value) if length is None else length
    if not explicit:
        return head + struct.pack(order + "I", n) + value
    return head + kind + (b"\0\0" + struct.pack(order + "I", n) if kind in LONG_HEADS else struct.pack(order + "H", n)) + value


def encode(frames: np.ndarray, tags: dict[str, str | int], syntax: str = EXPLICIT, before: Iterable[bytes] = ()) -> bytes:
    """A file of these frames (8, 16 or 32 bits, signed or not) and tags; before: elements, encoded already, that come first."""
    order, explicit = ">" if syntax == BIG else "<", syntax != IMPLICIT
    kinds = {"StudyDate": b"DA", "Modality": b"CS", "Manufacturer": b"LO", "BodyPartExamined": b"CS", "PatientPosition": b"CS", "ViewPosition": b"CS", "PhotometricInterpretation": b"CS", "NumberOfFrames": b"IS"}
    bits = frames.dtype.itemsize * 8
    told = {"SamplesPerPixel": 1, "NumberOfFrames": str(len(frames)), "Rows": frames.shape[1], "Columns": frames.shape[2], "BitsAllocated": bits, "BitsStored": bits, "PixelRepresentation": int(frames.dtype.kind == "i"), **tags}
    own = [(ELEMENTS[n], b"US" if n in SHORTS else kinds.get(n, b"DS"), struct.pack(order + "H", v) if n in SHORTS else str(v).encode("latin-1")) for n, v in told.items()]
    own.append((ELEMENTS["PixelData"], b"OB" if bits == 8 else b"OW", frames.astype(frames.dtype.newbyteorder(order)).tobytes()))
    body = b"".join([*before, *[_element(*x, explicit, order) for x in sorted(own)]])
    if syntax == DEFLATED:
        deflate = zlib.compressobj(wbits=-15)
        body = deflate.compress(body) + deflate.flush()
    meta = _element(ELEMENTS["TransferSyntaxUID"], b"UI", syntax.encode(), True, "<")
    return bytes(128) + b"DICM" + _element((0x0002, 0x0000), b"UL", struct.pack("<I", len(meta)), True, "<") + meta + body
