"""SimHash near-duplicates: exact Hamming links by vantage-point trees, classes by connected components.

Fingerprints: texts are lower-cased in A-Z, cut at blank and the control characters 9 to 13, and every run
of consecutive words (shingle) votes with the bits of its XXH64. Arithmetic runs over whole batches of
shingles at once.

Links: equal fingerprints are one node. A vantage-point tree over a bounded sample of fingerprints splits
Hamming space into shards by distance to vantage fingerprints. A fingerprint is stored in one shard and
asks its own and those later shards that the triangle bound |d(q,v) - d(p,v)| <= d(p,q) can't exclude.
Shards and askers are dealt out in blocks of bounded size, so no group, however dense, lands in one task.
Within a block further vantage points cut the work by the same bound, and only as many links leave as
join what is linked there.

`keep_first` can check links by the Jaccard similarity of whole sets of shingles: texts that the tree's links join are
candidates, and so are, as similar texts may have fingerprints further apart, those that share one of the least hashes of
their sets, which all similar pairs do. Pairs of candidates verify on whole sets before they link.

Nulls: a null text has no words, fingerprint zero, and links like any other; a null doc_id keeps its row
and may join others, but is never a component_id unless no other id is reachable (then null). Repeated
rows give repeated results; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_map, fresh, join_facts, materialise
from lectern.llm.components import components

WORDS, DISTANCE, SEED = 4, 4, 42

#: Fingerprints that the tree of shards is built from, wanted size of a shard, deepest tree.
TREE_SAMPLE, SHARD, DEPTH = 8192, 8192, 9
#: Stored fingerprints and askers in one task at most (both about, by hashing).
BLOCK_POINTS, BLOCK_ASKERS = 16_384, 65_536
#: Sets of one part of a group; two parts are compared in one task.
BLOCK_SETS = 2048
#: Ids that are broadcast at most (8 bytes each), and after other stages, where the driver has little memory left (a table of
#: ids in its heap takes some fifty bytes an id, and stays there for a while); more are joined by shuffle.
BROADCAST_IDS, STAGE_IDS = 1 << 21, 1 << 14
#: Edges of a task at least where the stage looks for components.
STAGE_EDGES = 50_000
#: Counts that bound the difference of two sets at least, and elements in a count of large sets about: unlike sets of any size differ enough to be told.
COUNTS, FILL = 128, 16
#: Characters of texts that are hashed at once, about.
GROUP = 1 << 20
#: Pairs compared without further pruning.
PLAIN = 1 << 18

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buffer[start:end] for arrays of places."""
    raw = np.frombuffer(buffer + bytes(40), np.uint8)
    eight = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(raw) - 8,), "<u4", raw, strides=(1,))
    s, size = np.uint64(seed), (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + P5, np.uint64)
        at = start.astype(np.int64).copy()
        if len(big := np.flatnonzero(size >= 32)):
            acc = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(big))
            while len(live):
                where = at[big[live]]
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], eight[where + 8 * i])
                at[big[live]] += 32
                live = live[end[big[live]] - at[big[live]] >= 32]
            g = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                g = (g ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[big] = g
        h += size
        live = np.flatnonzero(end - at >= 8)
        while len(live):
            where = at[live]
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), eight[where]), 27) * P1 + P4
            at[live] = where + 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        h[live] = _rotl(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero(end > at)
        while len(live):
            h[live] = _rotl(h[live] ^ (raw[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            live = live[end[live] > at[live]]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        return h ^ (h >> np.uint64(32))


def _shingles(texts: list[str], words: int) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts that have words, and of these a buffer, the number of shingles; of each shingle its text, start and end."""
    # bytes.split() cuts at exactly the six white-space bytes
    clean = [b" ".join(t.encode("utf-8", "replace").lower().split()) for t in texts]
    which = np.flatnonzero([bool(c) for c in clean])
    buffer = b"\n".join([clean[i] for i in which])
    raw = np.frombuffer(buffer, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    begin, stop = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    last = np.concatenate([np.flatnonzero(np.concatenate([raw[gaps] == 10, [True]])) + 1])  # words up to each text's end
    count = np.diff(last, prepend=0)[: len(which)]
    last = last[: len(which)]
    shingles = np.maximum(count - words + 1, 1)
    owner = np.repeat(np.arange(len(which)), shingles)
    first = (last - count)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    return which, buffer, shingles, owner, begin[first], stop[np.minimum(first + words, last[owner]) - 1]


def in_groups(texts: list[str], fn: Callable[[list[str]], Any]) -> list[Any]:
    """The results of fn for groups of texts of about GROUP characters: memory doesn't depend on how long the texts of a batch are."""
    out, own, chars = [], [], 0
    for t in texts:
        own.append(t)
        chars += len(t)
        if chars > GROUP:
            out.append(fn(own))
            own, chars = [], 0
    return [*out, fn(own)] if own or not out else out


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    """The SimHash of each text as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    which, buffer, shingles, owner, start, end = _shingles(texts, words)
    if not len(which):
        return out
    out[which] = _voted(lambda part: xxh64(buffer, start[part], end[part]), owner, shingles)
    return out


def _voted(hashes: Callable[[slice], np.ndarray], owner: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of texts, given the hashes of a range of shingles, the text of each shingle and the number of each text's shingles."""
    votes = np.zeros((len(shingles), 64), np.int64)
    step = 1 << 17
    for i in range(0, len(owner), step):
        bits = np.unpackbits(hashes(slice(i, i + step)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + step]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    ones = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def sets_of(texts: list[str], words: int) -> list[np.ndarray]:
    """The XXH64 of each text's shingles, each once, in ascending order of the signed value."""
    return sets_and_prints(texts, words, False)[0]


def sets_and_prints(texts: list[str], words: int, prints_too: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """As sets_of, and the texts' fingerprints."""
    out, prints = [np.zeros(0, np.int64)] * len(texts), np.zeros(len(texts), np.uint64)
    which, buffer, shingles, owner, start, end = _shingles(texts, words)
    if len(which):
        h = xxh64(buffer, start, end)
        if prints_too:
            prints[which] = _voted(lambda part: h[part], owner, shingles)
        for i, own in zip(which, np.split(h.view(np.int64), np.cumsum(shingles)[:-1]), strict=True):
            out[i] = np.unique(own)
    return out, prints


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), text_key (tells texts of one doc_id apart) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is not None else "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(in_groups(texts, lambda own: fingerprints_of(own, words))).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_key"])

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, fp long, text_key long")


# ---- vantage-point trees ----


def _distance(a: np.ndarray, b: Any) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, depth: int, _next: list[int] | None = None) -> tuple | int:
    """A leaf's number, or (vantage fingerprint, radius, inner tree, outer tree); leaves count from 0."""
    _next = [0] if _next is None else _next
    if depth and len(sample) >= 4:
        # of a few candidates the one whose distances spread most prunes best
        tries = sample[: min(8, len(sample))]
        vantage = max(tries, key=lambda v: float(np.var(_distance(sample, v).astype(float))))
        d = _distance(sample, vantage)
        radius = int(np.median(d))
        if (d <= radius).any() and (d > radius).any():
            return (int(vantage), radius, build_tree(sample[d <= radius], depth - 1, _next), build_tree(sample[d > radius], depth - 1, _next))
    _next[0] += 1
    return _next[0] - 1


def leaves_of(tree: tuple | int, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, leaf) for each leaf that the triangle bound leaves; with slack 0 the home leaf alone."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(tree, np.arange(len(fps)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            found.append((own, np.full(len(own), node)))
            continue
        vantage, radius, inner, outer = node
        d = _distance(fps[own], np.uint64(vantage)).astype(np.int64)
        todo += [(inner, own[d - slack <= radius]), (outer, own[d + slack > radius])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def close_pairs(points: np.ndarray, askers: np.ndarray, distance: int, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in points, in askers) of all pairs within distance, in pieces."""
    if not len(points) or not len(askers):
        return
    if len(points) * len(askers) > PLAIN and min(len(points), len(askers)) > 64 and level < 6:
        vantage = points[(len(points) * (2 * level + 1)) // 16]
        dp, da = _distance(points, vantage).astype(np.int64), _distance(askers, vantage).astype(np.int64)
        if dp.min() != dp.max():
            by, ask = np.argsort(dp, kind="stable"), np.argsort(da, kind="stable")
            sorted_dp, values = dp[by], np.unique(da)
            bounds = np.searchsorted(da[ask], np.concatenate([values, [values[-1] + 1]]))
            for i, v in enumerate(values):
                shell = by[np.searchsorted(sorted_dp, v - distance, "left") : np.searchsorted(sorted_dp, v + distance, "right")]
                own = ask[bounds[i] : bounds[i + 1]]
                for p, a in close_pairs(points[shell], askers[own], distance, level + 1):
                    yield shell[p], own[a]
            return
    rows = max(1, PLAIN // len(points))
    for i in range(0, len(askers), rows):
        a, p = np.nonzero(np.bitwise_count(askers[i : i + rows, None] ^ points[None, :]) <= distance)
        if len(a):
            yield p, a + i


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the graph of edges a-b, without the least nodes themselves."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _links_of_block(block: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links among a block's stored fingerprints and askers; several shards' blocks may share a group."""
    kept = []
    fp, asks, home = block["fp"].to_numpy().view(np.uint64), block["asks"].to_numpy(), block["home"].to_numpy()
    points, askers, visiting = fp[~asks], fp[asks], ~home[asks]
    a_all, b_all, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if a_all:
            kept.append(spanning(np.concatenate(a_all), np.concatenate(b_all)))
        a_all.clear(), b_all.clear()
        held = 0

    for p, a in close_pairs(points, askers, distance):
        # at home each pair would be seen from both ends
        own = visiting[a] | (points[p] < askers[a])
        if own.any():
            a_all.append(askers[a[own]])
            b_all.append(points[p[own]])
            held += int(own.sum())
            if held > 1 << 21:
                flush()
    flush()
    u = np.concatenate([k[0] for k in kept]) if kept else np.zeros(0, np.uint64)
    v = np.concatenate([k[1] for k in kept]) if kept else np.zeros(0, np.uint64)
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints (column fp) exactly as all links within distance do."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy().view(np.uint64)
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / SHARD))))
    tree = build_tree(sample, depth)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        home = np.empty(len(fps), np.int64)
        i, leaf = leaves_of(tree, fps, 0)
        home[i] = leaf
        i, leaf = leaves_of(tree, fps, distance)
        later = leaf >= home[i]
        i, leaf = i[later], leaf[later]
        every = np.arange(len(fps))
        fp = np.concatenate([fps, fps[i]]).view(np.int64)
        asks = np.concatenate([np.zeros(len(fps), bool), np.ones(len(i), bool)])
        at_home = np.concatenate([np.ones(len(fps), bool), leaf == home[i]])
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(asks), pa.array(at_home), pa.array(np.concatenate([home[every], leaf]))], names=["fp", "asks", "home", "leaf"])

    routed = materialise(arrow_map(distinct.select("fp"), route, "fp long, asks boolean, home boolean, leaf long"), "routed")
    # at most 2 ** DEPTH rows
    sizes = routed.groupBy("leaf").agg(F.count_if(~F.col("asks")).alias("points"), F.count_if(F.col("asks")).alias("askers"))
    sizes = sizes.select("leaf", F.ceil(F.col("points") / BLOCK_POINTS).alias("pb"), F.ceil(F.col("askers") / BLOCK_ASKERS).alias("ab"))
    mixed = F.xxhash64("fp", F.lit(1))
    own = F.when(F.col("asks"), F.pmod(mixed, F.greatest("ab", F.lit(1)))).otherwise(F.pmod(mixed, F.greatest("pb", F.lit(1))))
    other = F.when(F.col("asks"), F.col("pb")).otherwise(F.col("ab"))
    dealt = (
        routed.join(F.broadcast(sizes), "leaf")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(other, F.lit(1)) - 1)))
        .select("leaf", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("p"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("a"), "fp", "asks", "home")
    )
    return dealt.groupBy("leaf", "p", "a").applyInPandas(lambda block: _links_of_block(block, distance), "u long, v long")


# ---- similar sets of shingles ----


def counts_of(elements: np.ndarray) -> np.ndarray:
    """How many elements have each value of some low bits; more bits for more elements."""
    width = max(COUNTS, 1 << max(0, len(elements) // FILL - 1).bit_length())
    return np.minimum(np.bincount(elements & (width - 1), minlength=width), 255).astype(np.uint8)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (64 bits that stand for the set), text_key, shingles (sorted), counts (a byte each), simhash of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is not None else "" for t in batch.column(1).to_pylist()]
        groups = in_groups(texts, lambda some: sets_and_prints(some, words))
        own, prints = [x for group, _ in groups for x in group], np.concatenate([p for _, p in groups])
        fp = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in own]
        counts = [counts_of(x).tobytes() for x in own]
        ends = np.cumsum([0] + [len(x) for x in own])
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp, pa.int64()), batch.column(2), sets, pa.array(counts, pa.binary()), pa.array(prints.view(np.int64))], names=["doc_id", "fp", "text_key", "shingles", "counts", "simhash"])

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, fp long, text_key long, shingles array<long>, counts binary, simhash long")


class _Bounds:
    """Sizes and counts of the sets of a block."""

    def __init__(self, size: np.ndarray, counts: list[bytes]):
        self.size, self.width = size, np.fromiter(map(len, counts), np.int64, len(counts))
        self.coarse, self.fine, self.place = np.zeros((len(size), COUNTS), np.int32), {}, np.zeros(len(size), np.int64)
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            each = np.frombuffer(b"".join([counts[i] for i in own]), np.uint8).reshape(-1, w)
            self.coarse[own] = each.reshape(len(own), -1, COUNTS).sum(1, dtype=np.int32)
            if w > COUNTS:
                self.fine[w], self.place[own] = each, np.arange(len(own))
        if w <= 1 << 14:
            self.coarse = self.coarse.astype(np.int16)
        self.sums = np.int16 if w <= 1 << 14 else np.int32

    def near(self, i: int, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of the sets at these places, none larger than set i, may differ from it in `most` elements or fewer.

        Two sets differ in at least as many elements as their counts do. COUNTS sums of counts are compared first, then all
        counts of the smaller set.
        """
        few = np.abs(self.coarse[at] - self.coarse[i]).sum(axis=1) <= most
        at, most = at[few], most[few]
        if self.width[i] == COUNTS or not len(at):
            return at
        whole = self.fine[self.width[i]][self.place[i]]
        keep = np.ones(len(at), bool)
        for w in np.unique(self.width[at]).tolist():
            if w > COUNTS:
                own = np.flatnonzero(self.width[at] == w)
                mine = whole.reshape(-1, w).sum(0, dtype=self.sums)
                keep[own] = np.abs(self.fine[w][self.place[at[own]]] - mine).sum(axis=1, dtype=np.int64) <= most[own]
        return at[keep]


def _joined(begin: int, end: int, bounds: _Bounds, similarity: float, sets: list[np.ndarray] | None) -> Iterator[tuple[int, int]]:
    """Places of pairs that join what all similar pairs of a group join; what is joined isn't compared again. Sizes ascend.

    Without sets the bound on their differences alone decides.
    """
    size, label = bounds.size[begin:end], np.arange(end - begin)
    for i in range(1, end - begin):
        low = int(np.searchsorted(size[:i], similarity * size[i] - 1e-9))
        at = low + np.flatnonzero(label[low:i] != label[i])
        least = np.ceil(similarity / (1 + similarity) * (size[low:i] + size[i]) - 1e-9)
        for j in (bounds.near(begin + i, begin + at, size[at] + size[i] - 2 * least[at - low]) - begin).tolist():
            if label[j] != label[i] and (sets is None or len(np.intersect1d(sets[begin + i], sets[begin + j], assume_unique=True)) >= least[j - low]):
                label[label == label[i]] = label[j]
                yield begin + i, begin + j


def _edges_of_block(block: pd.DataFrame, similarity: float, whole: bool) -> pd.DataFrame:
    """Edges within each group (key, p, q) of a block; whole: by the sets themselves, otherwise by the bound."""
    block = block.sort_values(["key", "p", "q", "size"], kind="stable")
    group = block[["key", "p", "q"]].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(block)]]).tolist()
    fp, bounds = block["fp"].to_numpy(), _Bounds(block["size"].to_numpy().astype(np.int64), block["counts"].tolist())
    sets = [np.asarray(x, np.int64) for x in block["shingles"]] if whole else None
    found = [pair for a, b in zip(cuts, cuts[1:]) for pair in _joined(a, b, bounds, similarity, sets)]
    at = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": fp[at[:, 0]], "v": fp[at[:, 1]]})


def _edges(member: DataFrame, own: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """Edges (u, v) among the members (key, fp) of each key; own: fp, size, counts, and shingles if whole."""
    # large groups are dealt out as pairs of parts, small ones share a block
    n = member.count()
    parts = member.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("parts"), F.count("*").alias("n"))
    blocks = math.ceil(max(1, n) / (2 * BLOCK_SETS))
    part = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("parts"))
    dealt = join_facts(member, parts, "key", "n", n, ["fp"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp").join(own, "fp")
    block = F.pmod(F.xxhash64("key", "p", "q"), F.lit(blocks)).alias("block")
    return dealt.groupBy(block).applyInPandas(lambda rows: _edges_of_block(rows, similarity, whole), "u long, v long")


def small_ids(ids: DataFrame, most: int | None = None) -> DataFrame:
    """ids (written before), to be broadcast unless they are more than `most`, by default BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids


def near_prints(sets: DataFrame, distance: int) -> DataFrame:
    """key, fp of the sets (fp, simhash) that share a class of fingerprints with another set: links within distance by the tree, components."""
    own = materialise(sets.select("simhash", "fp").distinct(), "prints")
    distinct = materialise(own.select(F.col("simhash").alias("fp")).distinct(), "distinct")
    roots = materialise(components(links(distinct, distance), task_edges=STAGE_EDGES, small_plans=True), "print-roots")
    named = materialise(own.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").select(F.coalesce("root", "simhash").alias("key"), "fp"), "print-classes")
    several = materialise(named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "print-sizes")
    return join_facts(named, several, "key", "n", own.count(), ["fp"]).select("key", "fp")


def similar(sets: DataFrame, similarity: float, distance: int) -> DataFrame:
    """Edges (u, v) that join the sets (fp, shingles, counts, simhash) exactly as all pairs with this Jaccard similarity or more do.

    Sets whose fingerprints the tree links within distance meet. For similar sets whose fingerprints lie further apart there is
    an exact way: of two similar sets the first n - ceil(similarity * n) + 1 elements in the order of the hash have one in common,
    so sets also meet under these; an element that only one set has meets none. Sets that meet and pass a bound on their
    counts form groups, and each set travels to its group alone.
    """
    size = F.size("shingles")
    each = sets.select("fp", F.explode(F.slice("shingles", F.lit(1), (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))).alias("key"))
    shared = each.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("key")
    rest = each.join(small_ids(materialise(shared, "met-keys"), STAGE_IDS), "key").select("key", "fp")
    met = materialise(near_prints(sets, distance).unionByName(rest).distinct(), "met")
    bounds = sets.select("fp", size.alias("size"), "counts").join(met.select("fp").distinct(), "fp", "left_semi").distinct()
    whole = lambda ids: sets.select("fp", size.alias("size"), "counts", "shingles").join(small_ids(ids, STAGE_IDS), "fp", "left_semi").dropDuplicates(["fp"])
    return joined(met, bounds, whole, similarity, STAGE_EDGES, True)


def joined(met: DataFrame, bounds: DataFrame, whole: Callable[[DataFrame], DataFrame], similarity: float, task_edges: int | None = None, small_plans: bool = False) -> DataFrame:
    """Edges (u, v) that join the members (fp) of each key of met exactly as all similar pairs of a key do.

    bounds: fp, size, counts of each set once; whole gives the same with the shingles for a table of fps. Both tables are read
    several times, so they should be written before. task_edges, small_plans: as for components.
    """
    near = materialise(components(_edges(met, bounds, similarity, False), task_edges=task_edges, small_plans=small_plans), "met-roots")
    member = near.select(F.col("root").alias("key"), F.col("node").alias("fp")).unionByName(near.select(F.col("root").alias("key"), F.col("root").alias("fp")).distinct())
    member = materialise(member, "met-groups")
    return _edges(member, whole(member.select("fp")), similarity, True)


def _named(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, text_key, root (the fingerprint that stands for the class) of every row of prints."""
    known = prints.groupBy("fp").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    facts = materialise(known.select("fp", F.coalesce("root", "fp").alias("root"), "n"), "fingerprints")
    return materialise(join_facts(prints, facts, "fp", "n", prints.count(), ["doc_id", "text_key"]).select("doc_id", "fp", "text_key", "root"), "classes")


def _similar_classes(docs: DataFrame, words: int, distance: int, similarity: float) -> DataFrame:
    """As _classes, with links checked by the similarity of sets of shingles; equal sets are one node."""
    sets = materialise(shingle_sets(docs, words), "sets")
    return _named(sets.select("doc_id", "fp", "text_key"), materialise(components(similar(sets, similarity, distance), task_edges=STAGE_EDGES, small_plans=True), "roots"))


def _classes(docs: DataFrame, words: int, distance: int) -> DataFrame:
    prints = materialise(fingerprints(docs, words), "simhash")
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    return _named(prints, materialise(components(links(distinct, distance)), "roots"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    rows = _classes(docs, words, distance)
    ids = materialise(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "components")
    return join_facts(rows, ids, "root", "n", rows.count(), ["doc_id", "text_key"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id (null last); of equal rows one stays.

    With similarity, links within distance count only if the sets of shingles have this Jaccard similarity, and so linked are all that have it.
    """
    rows = _classes(docs, words, distance) if similarity is None else _similar_classes(docs, words, distance, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = materialise(rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first")
    marked = materialise(join_facts(rows, first, "root", "n", rows.count(), ["doc_id", "text_key"]).select("doc_id", "text_key", order.eqNullSafe(F.col("first")).alias("stays")).groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "marks")
    doc, key = fresh(docs, "__doc"), fresh(docs, "__text")
    same = F.col("d.doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("d.text") == F.col(key))
    pick = lambda condition: marked.filter(condition).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    docs = docs.alias("d")
    single = docs.join(pick("NOT stays OR n > 1"), same, "left_anti")
    again = docs.join(pick("stays AND n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(again)
