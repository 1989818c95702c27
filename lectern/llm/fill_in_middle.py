"""Fill-in-the-middle arrangements of texts, as column expressions alone.

A text is cut into lines (each with its line feed; the last may have none). Two cuts drawn from a digest of the seed
and doc_id part the lines into prefix, middle and suffix, which are written behind sentinels, either in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm). Parsing at the sentinels gives the text back.

Every row is arranged by itself: no shuffle, whatever the table holds. Nulls: a null text is empty; a null doc_id
is drawn by the seed alone. Empty texts, texts that hold a sentinel and those that the rate leaves out stay as
they are (form plain). Repeated rows are arranged alike; an empty table gives an empty one; further columns, whatever their names, are kept
by `transform` and not read by `arrange`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"
UNITS = r"[^\n]*\n|[^\n]+"

SEED, RATE, SPM = 7, 100, 50


def draw(seed: int, key: Column, i: int) -> Column:
    """The i-th (from 0) of the digest's groups of eight digits as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _arranged(rows: DataFrame, carried: list[str], seed: int, rate: int, spm: int) -> DataFrame:
    """The carried columns, n, form, prefix_chars, middle_chars, output of rows (doc_id, text and the carried columns)."""
    key, keep = F.col("doc_id"), ["doc_id", "text", *carried]
    cut = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carried).withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)))
    n = F.size("units")
    one, two = (F.pmod(draw(seed, key, i), n + 1) for i in (0, 1))
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINELS) | (draw(seed, key, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(seed, key, 3) % 100 < spm, "spm").otherwise("psm")
    placed = cut.select(*keep, "units", n.cast("long").alias("n"), F.least(one, two).cast("int").alias("low"), F.greatest(one, two).cast("int").alias("high"), form.alias("form"))
    low, high = F.col("low"), F.col("high")

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start, length), "")

    parts = placed.select(*keep, "n", "form", part(F.lit(1), low).alias("prefix"), part(low + 1, high - low).alias("middle"), part(high + 1, n - high).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    suffix_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    arranged = F.col("form") != "plain"
    return parts.select(
        *carried,
        "n",
        "form",
        F.when(arranged, F.length("prefix")).cast("long").alias("prefix_chars"),
        F.when(arranged, F.length("middle")).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", suffix_first).otherwise(F.col("text")).alias("output"),
    )


def arrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (null if plain), output of every row.

    rate: per cent of the texts that are arranged; spm: per cent of these that begin with the suffix.
    """
    return _arranged(docs.select(F.col("doc_id").alias("own"), "doc_id", "text"), ["own"], seed, rate, spm).withColumnRenamed("own", "doc_id")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    # what stands behind each sentinel; an arranged text holds no others
    parts = F.split(output, SENTINELS)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def transform(docs: DataFrame, form: str = "form", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with all rows and columns, each text arranged, and its form in a further column, which docs must not have."""
    if fresh(docs, form) != form:
        raise ValueError(f"docs has a column {form} already")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    made = _arranged(rows, ["row"], seed, rate, spm)
    return made.select(*[F.col("output").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("form").alias(form))
