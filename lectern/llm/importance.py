"""Importance resampling towards a target distribution, in DataFrame operations alone.

Features of a text are its runs of one to three consecutive words, hashed into buckets by crc32. How often the buckets
occur in the corpus and in the target texts gives each bucket a gain (a rounded log ratio with one added to each count), and
a document's weight is the sum of its features' gains. Adding Gumbel noise drawn from doc_id to the weights and
taking the highest scores draws documents without replacement, in proportion to the exponentials of their weights.

Each word of a document is exploded with the array of the runs that begin there; counts and sums are aggregated before
they are shuffled, so a hot bucket or a very long document costs the shuffle one row for each task. The gain table has as many rows as there are buckets, the bound
of what is broadcast. Ranks come from a sort by ranges, written once, in which a row's rank is its place in its part after all
rows of the parts before; only the number of rows of each part meets in one task.

Words: A-Z is lower-cased, and words are runs of digits, letters a-z and all characters beyond 127. Nulls: a null text has
no words; a null doc_id draws by the seed alone and comes last among equal scores. Documents without words weigh 0. Repeated rows
are weighed and drawn each by itself. An empty corpus gives no rows; empty target texts count as no
features. Further columns aren't read by `resample` and are kept by `drawn`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, BUCKETS = 3, 10_000
LEAST_WORDS, SHARE, SEED = 20, 5, 42

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() may change further letters, but not in texts of one byte a character, where it is the faster
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def exploded(texts: DataFrame, kept: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The kept columns, n_words and bucket: a row for each feature and rows of a null bucket where a run would pass the end."""
    worded = texts.select(*kept, words_of(F.col("text")).alias("words"))
    each = worded.select(*kept, F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("at", "word"))
    runs, run = [], F.col("word")
    for k in range(longest):
        run = run if not k else F.concat(run, F.lit(" "), F.get("words", F.col("at") + k))
        runs.append(F.crc32(run.cast("binary")) % buckets)
    return each.select(*kept, "n_words", F.explode(F.array(*runs)).alias("bucket"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n of the buckets that occur in the column text."""
    return exploded(texts.select("text"), [], buckets, longest).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket of the corpus, from bucket counts of corpus and target."""
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    totals = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row each
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = ((d["t"] + 1) * (d["all_s"] + buckets)) / ((d["s"] + 1) * (d["all_t"] + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """A thousandth-rounded Gumbel variate drawn from the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain_of: DataFrame, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, row (a number of its own), n_words, n_features, weight, score of every row."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    each = exploded(rows, ["row", "doc_id"], buckets, longest).join(F.broadcast(gain_of), "bucket", "left")
    summed = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scores: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores (doc_id, n_words, n_features, score, row) with rank, from 1, of the drawn rows: share per cent of those with enough words, rounded down."""
    fit = scores.withColumn("fit", F.col("n_words") >= least_words)
    ordered = fit.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "row")
    # part and place of a row in the sorted table
    placed = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part of the sort
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("fit").over(Window.partitionBy()) * share / 100).alias("drawn"))
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place + 1)
    return numbered.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).drop("part", "at", "before", "drawn", "fit")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs; target holds texts in its column text."""
    counts = [materialise(bucket_counts(t, buckets, longest), "buckets") for t in (docs, target)]
    gain_of = materialise(gains(*counts, buckets), "gains")
    return ranked(scored(docs, gain_of, seed, buckets, longest), share, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is drawn; a null doc_id never is."""
    key = fresh(docs, "__doc")
    ids = resample(docs, target, **settings).filter("rank IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(key), "left_semi")
