"""Nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking, and bounds that tell what was missed.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors of the least hash of vec_id); every
vector is indexed. A query first visits the lists whose centroids have the largest inner product with it, looks its
distances up in one asymmetric table for each query (inner products with all codewords), and reranks
the best codes of each list by the exact inner product in double precision. How many lists it visits first is learned
from the sample: the fewest whose lists hold the share RECALL of its own neighbours.

What it found k-th is the least score that an answer can have. So it then visits every list whose centroid and radius
allow that score (q.x <= q.c + |q| |x - c|), and in these reranks every vector whose codes and quantisation
error allow it (q.x <= q.c + q.y + |q| |x - c - y| with the codewords y). No nearer vector is left out, whatever the
vectors, the queries and the sample are like; the sample and RECALL decide on the work alone.

Lists are gathered in blocks, and large ones cut, of at most about BLOCK vectors by a hash, so a list that holds a third of all
vectors is searched by many tasks; a query is sent once to each block that holds a list it visits, and a block answers with its own best k.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as
rows with a null vec_id. Repeated rows are candidates as often as they occur; of different vectors under one vec_id the least, in
the order of arrays, is the query, and none is its candidate; ties go to the smaller vec_id; an
empty table gives none; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_map, materialise

K, EVERY = 20, 20
SAMPLE, ROUNDS = 20_000, 8
LISTS, PARTS, CODES = 512, 16, 256
#: Share of the sample's neighbours that the lists visited first hold, lists that are visited at least, and vectors of the sample that ask.
RECALL, PROBE_LEAST, TEACHERS = 0.5, 8, 512
#: Best codes of a list that are reranked at first, for each of the k wanted.
RERANK = 4
#: Stored vectors and queries that meet in one task at most, about; vectors of a block at least, and blocks of a table that isn't large.
BLOCK, ASKERS, BLOCK_LEAST, BLOCKS = 32_768, 32_768, 1024, 24
#: Queries whose tables are held at once, scores and vectors that are held at once, about.
TABLES, SCORES, VECTORS = 512, 1 << 20, 1 << 22
#: Bounds are widened by this share of the lengths that enter them: far more than sums in double precision are off.
ROUNDING = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random start; empty ones restart at random points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(own, weights=x[:, d], minlength=k) / np.maximum(n, 1)
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # parts x codes x dimension of a part
    probes: int

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and the codes of its residual."""
        own = nearest(x, self.centroids)
        left = self._parts(x - self.centroids[own])
        return own, np.stack([nearest(left[:, m], self.codebooks[m]) for m in range(len(self.codebooks))], 1).astype(np.uint8)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, width = len(self.codebooks), self.codebooks.shape[2]
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: queries x parts x codes."""
        return np.einsum("qmd,mcd->qmc", self._parts(q), self.codebooks, optimize=True)

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each vector lies from its centroid, and from what its codes stand for."""
        left = x - self.centroids[own]
        coded = np.stack([self.codebooks[m][codes[:, m]] for m in range(len(self.codebooks))], 1).reshape(len(x), -1)[:, : x.shape[1]]
        widened = ROUNDING * (lengths(x) + lengths(self.centroids)[own] + lengths(coded))
        return lengths(left) + widened, lengths(left - coded) + widened

    def visits(self, q: np.ndarray, least: np.ndarray | None, radius: np.ndarray) -> np.ndarray:
        """Whether each query visits each list: all that allow the score `least`, or without scores the best by their centroids."""
        at = q @ self.centroids.T
        if least is None:
            found = np.zeros(at.shape, bool)
            np.put_along_axis(found, np.argsort(-at, axis=1, kind="stable")[:, : self.probes], True, axis=1)
        else:
            # negated, so that what isn't a number excludes nothing
            found = ~(at + lengths(q)[:, None] * radius < least[:, None])
        return found & (radius >= 0)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists in visiting order that hold this share of the k nearest, within the sample and for some of it."""
    if len(sample) <= k:
        return len(c)
    asked = sample[:: max(1, len(sample) // TEACHERS)]
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each list in each query's order
    near = np.argpartition(-(asked @ sample.T), k, axis=1)[:, : k + 1]
    needed = np.sort(np.take_along_axis(place, nearest(sample, c)[near], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def train(sample: np.ndarray, rows: int, lists: int = LISTS, parts: int = PARTS, neighbours: int = K, recall: float = RECALL) -> Index:
    k = int(min(lists, max(1, round(rows**0.5)), max(1, len(sample) // 16)))
    c = kmeans(sample, k)
    left = sample - c[nearest(sample, c)]
    parts = min(parts, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    cut = np.pad(left, ((0, 0), (0, parts * width - sample.shape[1]))).reshape(len(sample), parts, width)
    books = np.stack([np.resize(kmeans(cut[:, m], CODES), (min(CODES, len(sample)), width)) for m in range(parts)])
    return Index(c, books, min(k, max(PROBE_LEAST, probes_for(sample, c, neighbours, recall))))


def valid(table: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & usable)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else -1))


def _matrix(column: pa.Array, kind: type = float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision: equal vectors get equal scores wherever they stand."""
    return np.add.reduce(x * q, axis=1)


def search(table: DataFrame, every: int = EVERY, k: int = K, lists: int = LISTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    rows = materialise(valid(table), "vectors")
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    index = train(np.stack([np.asarray(x, float) for x in sample]), n, lists, neighbours=k, recall=recall)
    shared = spark.sparkContext.broadcast(index)  # LISTS centroids and PARTS x CODES codewords

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1))
        own, codes = shared.value.assign(x)
        far, off = shared.value.errors(x, own, codes)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(off), batch.column(1)], names=["vec_id", "list", "codes", "far", "off", "v"])

    stored = materialise(arrow_map(rows, place, "vec_id long, list int, codes binary, far double, off double, v array<double>"), "ivf")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = materialise(queries, "queries")
    layout = Layout.of(stored, len(index.centroids), min(BLOCK, max(BLOCK_LEAST, n // BLOCKS)))
    first = _best(_answers(stored, queries, shared, layout, k, True), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # where the lists visited first hold fewer than k, any score may be among the best
    asked = queries.join(first, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    return _best(_answers(stored, materialise(asked, "asked"), shared, layout, k, False), k)


@dataclass
class Layout:
    """Blocks of stored vectors: the first block of each list, how many it is dealt over, and its radius (negative: it is empty)."""

    first: np.ndarray
    parts: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(stored: DataFrame, lists: int, most: int) -> Layout:
        n, radius = np.zeros(lists, np.int64), np.full(lists, -1.0)
        for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # LISTS rows at most
            n[r["list"]], radius[r["list"]] = r["n"], r["far"]
        first, parts, block, held = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
        for i in range(lists):
            if held and held + n[i] > most:
                block, held = block + 1, 0
            first[i], parts[i] = block, max(1, -(-n[i] // most))
            held += n[i]
            if parts[i] > 1:
                block, held = block + parts[i], 0
        return Layout(first, parts, radius)


def _best(answers: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each query."""
    order = np.lexsort((ids, -score, query))
    begin = np.flatnonzero(np.diff(query[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order))) < k]


def _allowed(near: np.ndarray, slack: np.ndarray, least: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) to be reranked: all that allow the score `least`, or without scores the best by their codes."""
    if least is not None:
        return np.nonzero(~(near + slack < least[:, None]))
    most = min(near.shape[1], RERANK * k + 1)
    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
    return np.repeat(np.arange(len(near)), most), best.reshape(-1)


def _answers(stored: DataFrame, queries: DataFrame, shared, layout: Layout, k: int, first: bool) -> DataFrame:  # noqa: ANN001
    """query_id, vec_id, score: the best k of each block, first of the best lists and codes, then of all that allow the score `least`."""

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        visits = shared.value.visits(_matrix(batch.column(1)), None if first else np.asarray(batch.column(2)), layout.radius)
        i, own = np.nonzero(visits)
        # a query is sent once to lists that share a block
        i, block = np.unique(np.stack([i, layout.first[own]]), axis=1)
        parts = np.ones(layout.first.max() + 1, np.int64)
        parts[layout.first] = layout.parts
        query, q, least = (c.take(pa.array(i)) for c in batch.columns)
        return pa.RecordBatch.from_arrays([query, pa.array(block), pa.array(parts[block]), q, least], names=["query_id", "block", "parts", "q", "least"])

    spark = stored.sparkSession
    # LISTS rows at most
    blocks = spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(layout.first, layout.parts, strict=True))], "list int, first long, parts long")
    turns = max(1, -(-queries.count() // ASKERS))
    zero = F.lit(0).cast("long")
    least = F.lit(0.0).alias("least") if first else "least"
    asked = arrow_map(queries.select("query_id", "v", least), route, "query_id long, block long, parts long, q array<double>, least double")
    asked = asked.select(F.explode(F.sequence("block", F.col("block") + F.col("parts") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).alias("askers"), "query_id", "q", "least")
    dealt = stored.join(F.broadcast(blocks), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"), F.explode(F.sequence(zero, F.lit(turns - 1).cast("long"))).alias("askers"), "vec_id", "list", "codes", "off", "v"
    )

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index, left = shared.value, left.sort_values("list", kind="stable")
        ids, own, off, x = left["vec_id"].to_numpy(), left["list"].to_numpy(), left["off"].to_numpy(), np.stack(left["v"].to_numpy())
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        cuts = [*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)]
        out = []
        for i in range(0, len(right), TABLES):
            part = right.iloc[i : i + TABLES]
            names, q = part["query_id"].to_numpy(), np.stack(part["q"].to_numpy())
            least = None if first else part["least"].to_numpy()
            at, tables, length, visits = q @ index.centroids.T, index.tables(q), lengths(q), index.visits(q, least, layout.radius)
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts, cuts[1:]):
                visitors = np.flatnonzero(visits[:, own[a]])
                step = max(1, SCORES // (b - a))
                for j in range(0, len(visitors), step):
                    who = visitors[j : j + step]
                    near = np.repeat(at[who, own[a]][:, None], b - a, axis=1)
                    for m in range(codes.shape[1]):
                        near += tables[who, m][:, codes[a:b, m]]
                    asks, found = _allowed(near, length[who][:, None] * off[a:b], None if first else least[who], k)
                    rows = max(1, VECTORS // x.shape[1])
                    for c in range(0, len(asks), rows):
                        u, v = who[asks[c : c + rows]], a + found[c : c + rows]
                        s = exact(q[u], x[v])
                        good = ids[v] != names[u]
                        if not first:
                            good &= ~(s < least[u])
                        kept.append((u[good], ids[v[good]], s[good]))
                        if sum(len(t[0]) for t in kept) > SCORES:
                            u, v, s = (np.concatenate(t) for t in zip(*kept))
                            best = _top(u, v, s, k)
                            kept = [(u[best], v[best], s[best])]
            if kept:
                u, v, s = (np.concatenate(t) for t in zip(*kept))
                best = _top(u, v, s, k)
                out.append(pd.DataFrame({"query_id": names[u[best]], "vec_id": v[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ["block", "askers"]
    return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(answer, "query_id long, vec_id long, score double")
