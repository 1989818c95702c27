"""Overlapping chunks by ever finer separators.

A text that is short enough is one chunk. Otherwise it is cut at the coarsest separator of SEPARATORS and the pieces
are packed greedily; a full chunk is followed by one that begins with the tail of the last, from a word's beginning; a
piece that alone is too long goes to the next finer separator, at last to windows of single characters. So no word is cut
where the overlap, a separator and the longest word fit into one chunk; a longer word beside a whole overlap is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST_TEXT = 512, 50, 50

# Fixed values, coarsest first.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def tail(text: str, n: int) -> str:
    """The last n characters from the first word that begins among them; all n without one."""
    if n <= 0:
        return ""
    end = text[-n:]
    _, *later = end.split(None, 1) if end[:1].strip() else ("", end.lstrip())
    return later[0].lstrip() if later and later[0].strip() else end


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def _packed(text: str, size: int, overlap: int, level: int) -> Iterator[str]:
    separator = SEPARATORS[level]
    if not separator:
        yield from (text[i : i + size] for i in range(0, len(text), size - overlap))
        return
    held = ""
    for part in text.split(separator):
        joined = f"{held}{separator}{part}" if held else part
        if len(joined) > size:
            if held:
                yield held
                joined = f"{tail(held, overlap)}{separator}{part}" if overlap and len(held) > overlap else part
            if len(joined) > size:
                yield from _packed(joined, size, overlap, level + 1)
                joined = ""
        held = joined
    if held:
        yield held


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of one text, stripped, without blank ones."""
    check(size, overlap)
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    return [c for c in (x.strip() for x in _packed(text, size, overlap, 0)) if c]


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    check(size, overlap)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap))

    return run(text)


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, with chunk_index and chunk."""
    cut = docs.withColumn("__chunks", chunks_of(F.col("text"), size, overlap)).drop("text")
    return cut.select("*", F.posexplode("__chunks").alias("chunk_index", "chunk")).drop("__chunks")


def character_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of single characters alone, as the finest separator gives them, without Python."""
    check(size, overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))), lambda x: F.length(x) > 0)


def register(spark: SparkSession) -> None:
    """The table function chunk_text(text, size, overlap) for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, chunk string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):  # noqa: ANN201
            yield from enumerate(chunk_text(text, size, overlap))

    spark.udtf.register("chunk_text", Chunks)
