"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

One weight vector serves all ordered thresholds: P(grade > k) = sigmoid(f(text) - theta_k), with
theta_0 < theta_1 < ...; the expected severity is the sum of these probabilities over k. Features are the
distinct words of the whole lower-cased text, each with its first four and first five characters,
hashed; f is the sum of their weights, so scoring a text is a sum over its distinct words.

The model is fitted on a bounded sample: the SAMPLE labelled documents of the least hash of doc_id, without those of over DOC_FEATURES
features, as many of the others as hold SAMPLE_FEATURES together; of documents with one doc_id the least text teaches. A label above 1 anywhere in the sample means that its
labels are grades; grades above GRADES - 1 count as that. Where the
label is binary, grades come from the sample itself: 0 for clean documents; toxic ones get 1 to GRADES - 1 by
quantiles of the number of their distinct words that mark toxic documents there.
A document is toxic when a grade above 0 is likelier than not.

Nulls: a null text is empty and scores as a text without words; labels without a document, with a null or below 0
teach nothing; a null doc_id keeps its row. With no labelled rows every text scores 0. Repeated rows
score alike, an empty table gives an empty one; of further columns none is read, and the filter keeps them all.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ARROW_ROWS, arrow_map, materialise, null_as_empty

SAMPLE, GRADES = 6000, 4
#: Features of the sample, of four bytes each: what the driver holds at most. Documents of more than DOC_FEATURES by themselves don't teach.
SAMPLE_FEATURES, DOC_FEATURES = 8_000_000, 80_000
BUCKETS = 1 << 20
LEAST, L1, ROUNDS, RATE, START, CHI = 8, 1e-5, 600, 0.5, 1e-4, 12.0
WORD = re.compile(r"\w+")
CACHE = 500_000


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> tuple[int, int, int]:
    """Buckets of the word and of its beginnings; short words are their own beginnings."""
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in ("w" + word, "4" + word[:4], "5" + word[:5]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    buckets: np.ndarray  # of the weights that aren't zero
    weights: np.ndarray
    thetas: np.ndarray

    def scorer(self):  # noqa: ANN201
        table = dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))
        known: dict[str, float] = {}

        def score(text: str) -> float:
            if len(known) > CACHE:
                known.clear()
            total = 0.0
            for w in words_of(text):
                s = known.get(w)
                if s is None:
                    s = known[w] = sum(table.get(b, 0.0) for b in features(w))
                total += s
            return total

        return score

    def exceed(self, f: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return _sigmoid(f[:, None] - self.thetas[None, :])


def thresholds(cut: np.ndarray) -> np.ndarray:
    """Ascending thresholds from the first one and the logarithms of the steps."""
    return cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])


def likelihood(f: np.ndarray, grades: np.ndarray, cut: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of the grades, and its gradients by f and by cut."""
    n, top = len(grades), len(cut)
    edge = np.concatenate([[-np.inf], thresholds(cut), [np.inf]])
    below, above = _sigmoid(edge[grades] - f), _sigmoid(edge[grades + 1] - f)
    below, above = np.where(grades == 0, 0, below), np.where(grades == top, 1, above)
    p = np.maximum(above - below, 1e-9)
    d_above, d_below = above * (1 - above) / p, below * (1 - below) / p
    grad_f = (1 - above - below) / n  # it doesn't vanish far from the thresholds
    d_theta = np.bincount(grades[grades > 0] - 1, weights=d_below[grades > 0], minlength=top) - np.bincount(grades[grades < top], weights=d_above[grades < top], minlength=top)
    tail = np.cumsum(d_theta[::-1])[::-1] / n
    return float(-np.log(p).mean()), grad_f, np.concatenate([[tail[0]], tail[1:] * np.exp(cut[1:])])


def fit(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray) -> Model:
    """rows, buckets: a feature of a document each (repeats count); grades: of every document, from 0."""
    top = int(grades.max(initial=0))
    own = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS) >= LEAST)
    if not top or not len(own):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(max(1, top), 40.0))
    place = np.full(BUCKETS, -1)
    place[own] = np.arange(len(own))
    n = len(grades)
    use = place[buckets] >= 0
    # distinct pairs with their numbers, in place: the driver's memory is short
    pairs = place[buckets[use]]
    pairs *= n
    pairs += rows[use]
    pairs.sort()
    fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    first = np.flatnonzero(fresh).astype(np.int32)
    times = np.diff(first, append=np.int32(len(pairs))).astype(np.float32)
    del first
    pairs = pairs[fresh]
    b = (pairs // n).astype(np.int32)
    pairs %= n
    r = pairs.astype(np.int32)
    del pairs, fresh
    # only features that go with toxicity or its absence take part
    bad, have = float((grades > 0).sum()), np.bincount(b, minlength=len(own)).astype(float)
    both = np.bincount(b[(grades > 0)[r]], minlength=len(own)).astype(float)
    chi = n * (both * n - have * bad) ** 2 / np.maximum(have * (n - have) * bad * (n - bad), 1)
    live = chi >= CHI
    own, use = own[live], live[b]
    b, r, times = (np.cumsum(live) - 1)[b[use]], r[use], times[use]
    w, square = np.zeros(len(own)), np.full(len(own), START)
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)])
    first, steps = -np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))
    cut, cut_square = np.concatenate([[first], steps]), np.full(top, START)
    for _ in range(ROUNDS):
        f = np.bincount(r, weights=w[b] * times, minlength=n)
        _, grad_f, g_cut = likelihood(f, grades, cut)
        g = np.bincount(b, weights=grad_f[r] * times, minlength=len(own))
        square += g * g
        rate = RATE / np.sqrt(square)
        w = w - rate * g
        w = np.maximum(w - rate * L1, 0)  # a feature may only raise the severity: harmless words don't hide toxic ones
        cut_square += g_cut * g_cut
        cut -= RATE * g_cut / np.sqrt(cut_square)
    live = np.flatnonzero(w)
    return Model(own[live], w[live], thresholds(cut))


def graded(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades for binary labels: toxic documents by quantiles of their number of distinct marking words."""
    if not toxic.any() or toxic.all() or grades <= 2:
        return toxic.astype(np.int64)
    bad = np.bincount(buckets[toxic[rows] > 0], minlength=BUCKETS)
    good = np.bincount(buckets[toxic[rows] == 0], minlength=BUCKETS)
    marks = (bad >= LEAST) & (bad / toxic.sum() > 8 * (good + 1) / (toxic == 0).sum())
    # three features a word
    marked = marks[buckets].reshape(-1, 3).any(1)
    number = np.bincount(rows[::3], weights=marked, minlength=len(toxic))
    cuts = np.quantile(number[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, number, "left"), 0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = GRADES, sample: int = SAMPLE) -> Model:
    """Fits on the bounded sample; a label above 1 is taken as a grade."""
    chosen = labels.filter((F.col(label) >= 0) & F.col("doc_id").isNotNull()).select("doc_id", F.least(F.col(label), F.lit(grades - 1)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most `sample` rows on either side
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array([x for w in sorted(words_of(t)) for x in features(w)], "<i4").tobytes() for t in null_as_empty(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    # the driver fits: it holds the sample's features
    told = materialise(arrow_map(texts, run, "doc_id long, label int, features binary"), "toxicity-sample").filter(F.length("features") <= 4 * DOC_FEATURES)
    so_far = F.sum(F.length("features") / 4).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = told.select("doc_id", "label", (F.length("features") / 4).cast("int").alias("own"), so_far.alias("n")).filter(F.col("n") <= SAMPLE_FEATURES)
    got = sorted(within.select("doc_id", "label", "own").collect())
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(grades - 1, 40.0))
    label_of = np.array([r["label"] for r in got], np.int64)
    # 32 bits, and each document's features put in their place as they come: the driver's memory is what the sample costs
    ends = np.cumsum([r["own"] for r in got])
    place = {r["doc_id"]: (end - r["own"], end) for r, end in zip(got, ends.tolist(), strict=True)}
    rows, buckets = np.repeat(np.arange(len(got), dtype=np.int32), [r["own"] for r in got]), np.empty(ends[-1], "<i4")
    del got
    for r in told.join(F.broadcast(within.select("doc_id")), "doc_id").select("doc_id", "features").toLocalIterator():
        begin, end = place[r["doc_id"]]
        buckets[begin:end] = np.frombuffer(r["features"], "<i4")
    return fit(rows, buckets, label_of if label_of.max() > 1 else graded(rows, buckets, label_of, grades))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (likeliest) and toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights at most

    made = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "f" not in made:
            made["f"] = shared.value.scorer()
        f = np.array([made["f"](t) for t in null_as_empty(batch.column(1))])
        over = shared.value.exceed(f)
        each = np.concatenate([np.ones((len(f), 1)), over], 1) - np.concatenate([over, np.zeros((len(f), 1))], 1)
        columns = [batch.column(0).cast(pa.int64()), pa.array(over.sum(1)), pa.array(over[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't toxic, with all their columns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):  # noqa: ANN001, ANN202
        f = shared.value.scorer()
        for batch in batches:
            if batch.num_rows:
                over = shared.value.exceed(np.array([f(t) for t in null_as_empty(batch.column(at))]))
                yield batch.filter(pa.array(over[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
