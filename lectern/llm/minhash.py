"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, star-shaped candidates, exact links.

Texts are lower-cased in A-Z and cut at blank and the control characters 9 to 13; a document's set holds the XXH64 of its
distinct runs of `words` words (fewer words: the whole sequence). The permuted universe is cut into BANDS * ROWS equal bins; a bin keeps its least
element, and an empty bin takes that of the first non-empty bin in a probe sequence of its own. Sets that agree in the ROWS bins of one of the BANDS
bands share a bucket: two sets of similarity 0.8 share none with a probability of (1 - 0.8^5)^36 = 6e-7.
Sets of fewer than four elements reach 0.8 only when they are equal, so they have no buckets.

Links are confirmed on full sets, candidates are stars: in each bucket the least set is the centre and every other one a
candidate of it, n - 1 pairs for n sets. Buckets whose other sets are of several classes even then may hide a link between two of
these: they are compared in blocks of bounded size, where what is joined isn't compared again. So every link between two sets that share a bucket counts.
Candidates of very unlike sizes are left out before any set travels. Equal sets are one node. Sets aren't stored for all documents: those
of candidates alone are built a second time.

Nulls: a null text has no words; texts without words are linked with nothing; a null doc_id keeps its row, may join others, and is a component_id
only where no other id is reachable. Repeated rows are linked like equal texts. An empty table gives none; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import HOT, arrow_map, join_facts, materialise, null_as_empty
from lectern.llm.components import components
from lectern.llm.simhash import P1, P3, _round, counts_of, in_groups, joined, sets_of, small_ids

WORDS, PERCENT = 2, 80
ROWS, BANDS = 5, 36
#: Rows of a task at least, where a step's rows are few.
TASK_ROWS = 50_000
#: Sets with fewer elements are similar only when they are equal.
LEAST = 4


@functools.cache
def _probe(attempt: int, k: int) -> np.ndarray:
    """The bin that each of k bins asks at this attempt if it is empty: the same for all sets."""
    bins = np.arange(k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = _round(np.full(k, P3, np.uint64), bins + np.uint64(attempt + 1) * P1)
        x ^= x >> np.uint64(32)
        return ((_round(x, bins) >> np.uint64(33)) % np.uint64(k)).astype(np.int32)


def bins_of(sets: list[np.ndarray], k: int) -> np.ndarray:
    """One row of k bins for each non-empty set (sorted by signed value, each element once)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    # in the order of the sets: the first element of a bin is its least
    u = np.concatenate(sets).view(np.uint64) ^ np.uint64(1 << 63)
    place = owner * k + ((u >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out, full = np.zeros(len(sets) * k, np.uint64), np.zeros(len(sets) * k, bool)
    out[place[first]], full[place[first]] = u[first], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        own = empty % k
        asked = empty - own + _probe(attempt, k)[own]
        found = full[asked]
        out[empty[found]] = out[asked[found]]
        empty, attempt = empty[~found], attempt + 1
    return out.reshape(len(sets), k)


def band_keys(sets: list[np.ndarray], rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One row of band keys for each set; equal keys mean equal bins in the same band."""
    bins = bins_of(sets, rows * bands).reshape(len(sets), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * P3, (len(sets), bands)).copy()
        for i in range(rows):
            key = _round(key, bins[:, :, i])
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _name(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, fp (64 bits that stand for the set), size, counts (a byte each), bands (null for small sets) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        def of(texts: list[str]) -> tuple:
            sets = sets_of(texts, words)
            large = [x for x in sets if len(x) >= LEAST]
            keys = iter(band_keys(large)) if large else iter(())
            return [(_name(x), len(x), counts_of(x).tobytes(), next(keys) if len(x) >= LEAST else None) for x in sets]

        made = [x for group in in_groups(null_as_empty(batch.column(1)), of) for x in group]
        bands = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([0 if m[3] is None else BANDS for m in made])]), pa.int32()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[m[3] for m in made if m[3] is not None]])),
        )
        columns = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary()), bands]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp", "size", "counts", "bands"])

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, text_key long, fp long, size long, counts binary, bands array<long>")


def _sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """fp, size, counts, shingles of the wanted fps, each once: built from one text of each."""
    texts = prints.select("fp", "text_key").join(wanted.distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key")).select("text_key")
    texts = materialise(texts, "minhash-texts")
    own = docs.select("text", F.xxhash64("text").alias("text_key")).join(small_ids(texts), "text_key", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x for group in in_groups(null_as_empty(batch.column(0)), lambda some: sets_of(some, words)) for x in group]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32()), pa.array(np.concatenate(sets)))
        columns = [pa.array([_name(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([counts_of(x).tobytes() for x in sets], pa.binary()), lists]
        return pa.RecordBatch.from_arrays(columns, names=["fp", "size", "counts", "shingles"])

    return materialise(arrow_map(own.select("text"), run, "fp long, size long, counts binary, shingles array<long>").dropDuplicates(["fp"]), "minhash-sets")


def _verified(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (centre u, other v) that are links. A centre of very many is dealt out, with its set for each part."""
    share = max(1, stars.count() // HOT)
    hot = stars.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > share).select("u", F.ceil(F.col("n") / share).alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts")))
    # one candidate for each band of v at most: v isn't hot
    of = lambda end: sets.select(F.col("fp").alias(end), F.col("size").alias(end + "_size"), F.col("shingles").alias(end + "_set"))
    others = stars.join(F.broadcast(hot), "u", "left").select("u", "v", part.alias("part")).join(of("v"), "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    centres = of("u").join(F.broadcast(hot), "u", "left").withColumn("part", every).drop("parts")
    common = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    both = others.join(centres, ["u", "part"])
    return both.filter(100 * common >= percent * (F.col("u_size") + F.col("v_size") - common)).select("u", "v")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, which holds about so many rows, in no more tasks than it needs."""
    return df.coalesce(max(8, rows // TASK_ROWS))


def links(docs: DataFrame, prints: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) of fps that join the sets as all links between sets of one bucket do."""
    total = prints.count() * BANDS
    each = prints.select("fp", "size", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.min(F.struct("fp", "size")).alias("centre"), F.max("fp").alias("high"), F.count("*").alias("n")).filter("centre.fp <> high")
    # a hot bucket's rows are dealt out here, and below once more
    parts = F.ceil(F.col("n") / max(1, total // HOT)).alias("parts")
    shared = materialise(shared.select("key", F.col("centre.fp").alias("centre"), F.col("centre.size").alias("centre_size"), "n", parts), "minhash-buckets")
    met = materialise(join_facts(each, shared, "key", "n", total, ["fp"]).filter("fp <> centre").distinct(), "minhash-met")
    n_met = met.count()
    # sets of very unlike sizes aren't similar
    fit = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    stars = materialise(_few(met.filter(fit).select(F.col("centre").alias("u"), F.col("fp").alias("v")).distinct(), n_met), "minhash-stars")
    sets = _sets(docs, prints, stars.select(F.explode(F.array("u", "v")).alias("fp")), words)
    found = materialise(_verified(stars, sets, percent), "minhash-links")

    # buckets whose sets, the centre left out, are of several classes yet
    roots = materialise(components(found, task_edges=TASK_ROWS), "minhash-roots")
    known = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "parts", F.coalesce("root", "fp").alias("root"))
    member = materialise(_few(known, n_met), "minhash-members")
    open_keys = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("parts").alias("parts")).filter("low <> high")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    dealt = member.select("key", "fp", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    rest = materialise(_few(dealt.join(open_keys.select("key", every), ["key", "part"]).select("key", "fp"), n_met), "minhash-rest")
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if rest.isEmpty():
        return stars
    facts = prints.select("fp", "size", "counts").join(rest.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])
    facts = materialise(_few(facts, n_met), "minhash-facts")
    return stars.unionByName(joined(rest, facts, lambda ids: _sets(docs, prints, ids, words), percent / 100, TASK_ROWS))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id) of every row."""
    prints = materialise(signatures(docs, words), "minhash")
    with_words = prints.filter("size > 0")
    known = with_words.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    roots = components(links(docs, prints.filter("bands IS NOT NULL AND size >= " + str(LEAST)), words, percent), task_edges=TASK_ROWS)
    n = prints.count()
    known = materialise(_few(known.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), n), "minhash-classes")
    classes = materialise(_few(known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_sets")), n), "minhash-components")
    named = materialise(_few(join_facts(known, classes, "root", "n_sets", known.count(), ["fp"]), n).select("fp", "component_id", "n"), "minhash-named")
    rows = _few(join_facts(with_words, named, "fp", "n", n, ["doc_id", "text_key"]), n).select("doc_id", "size", "component_id")
    rows = rows.unionByName(prints.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
