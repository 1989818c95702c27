"""Mixture-controlled packing by deficit round-robin over source queues, without a sequential pass.

Every source is a queue of tokens. Each round fills one window: the credit of queue s grows by its quantum
q(s) = window * share(s), it serves what whole tokens its credit allows, and the remaining deficit, less
than one token, is carried into the next window. With the quanta summed up over the queues,
Q(s) = q(1) + ... + q(s), what queue s has served after r windows is

    floor(r * Q(s)) - floor(r * Q(s-1)),

always within one token of r * q(s), and all queues together have served r * window exactly: no window
but the last needs padding. The deficit is thus a function of the window's number, so any partition knows
the deficits its documents meet, and a queue may cross any number of partitions. The targets are
the queues' shares of all tokens unless given, so the queues run dry together and no token is dropped.
With given targets the queues that run dry leave the mixture, and the others share their part; what a queue serves between two such
changes is a whole number of tokens, so it may be another token off.

A queue needs at least one token a window: sources below that share wait in one common queue (ordered by
partition and source), so there are at most 2 * window queues, a proven bound for what tasks are told of them.

Nulls: a null text is empty and packs only its end id; a null source is a source; a null doc_id is kept.
Repeated rows are packed repeatedly; an empty table packs to nothing; further columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_map, materialise
from lectern.llm.tokens import default_vocabulary, encoder

WINDOW, END_ID = 2048, 1

#: Runs (a partition's share of a source) that are broadcast at most; more are joined by shuffle.
BROADCAST_RUNS = 1 << 17

#: The common queue of small sources.
REST = "\x00rest"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@dataclass
class Phase:
    """Windows in which the same queues take part: first window, tokens, and per queue where it starts and its tokens."""

    first: int
    total: int
    begin: list[int]
    before: list[int]  # tokens of this phase in earlier queues, one entry more than queues

    def served(self, queue: int, r: int, window: int) -> int:
        if r * window >= self.total:
            return self.before[queue + 1] - self.before[queue]
        return r * window * self.before[queue + 1] // self.total - r * window * self.before[queue] // self.total


def _mixed(left: list[int], shares: list[float], window: int) -> list[int] | None:
    """What each queue serves in the longest run of full windows at the wanted shares, or None if no window is left."""
    live = [i for i, n in enumerate(left) if n and shares[i] > 0]
    while live:
        whole = sum(shares[i] for i in live)
        quantum = {i: window * shares[i] / whole for i in live}
        short = [i for i in live if left[i] < quantum[i] or quantum[i] < 1]
        if not short:
            tokens = window * int(min(left[i] / quantum[i] for i in live))
            exact = {i: tokens * shares[i] / whole for i in live}
            take = [min(left[i], int(exact[i])) if i in exact else 0 for i in range(len(left))]
            for i in sorted(live, key=lambda i: int(exact[i]) - exact[i]):
                take[i] += min(left[i] - take[i], 1, tokens - sum(take))
            return take if sum(take) == tokens else None
        live = [i for i in live if i not in short]
    return None


def schedule(totals: list[int], shares: list[float] | None = None, window: int = WINDOW) -> list[Phase]:
    """The phases of deficit round-robin over queues of these lengths."""
    left, at, phases, first = list(totals), [0] * len(totals), [], 0
    while sum(left):
        take = _mixed(left, shares, window) if shares is not None else None
        if take is None:
            # in proportion to what is left; queues below a token a window follow one after the other
            small = [i for i, n in enumerate(left) if 0 < n * window < sum(left)]
            large = [0 if i in small else n for i, n in enumerate(left)]
            if sum(large):
                take = large
                if small:
                    largest = max(range(len(take)), key=take.__getitem__)
                    cut = sum(take) % window
                    take[largest] -= cut if (take[largest] - cut) * window >= sum(take) - cut and take[largest] > cut else 0
            else:
                take = [n if i == small[0] else 0 for i, n in enumerate(left)]
            if any(0 < n * window < sum(take) for n in take):
                take = [n if n == max(take) and i == take.index(max(take)) else 0 for i, n in enumerate(take)]
        before = [0]
        for n in take:
            before.append(before[-1] + n)
        phases.append(Phase(first, before[-1], list(at), before))
        first += -(-before[-1] // window)
        at = [a + n for a, n in zip(at, take, strict=True)]
        left = [a - n for a, n in zip(left, take, strict=True)]
    return phases


def pieces(phases: list[Phase], ends: list[int], queue: int, start: int, n: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, window, offset) of a document at start of its queue; ends: of the queue by phase."""
    out = []
    at = start
    while at < start + n:
        p = bisect.bisect_right(ends, at)  # phases in which the queue serves nothing end where they begin
        phase = phases[p]
        local, stop = at - phase.begin[queue], min(start + n, ends[p]) - phase.begin[queue]
        own, total = phase.before[queue + 1] - phase.before[queue], phase.total
        r = max(0, local * total // (own * window) - 1)
        while r and phase.served(queue, r, window) > local:
            r -= 1
        # low and high: what earlier queues, without and with this one, have served after r windows
        low, high = phase.before[queue] * window, phase.before[queue + 1] * window
        under, over = (phase.before[queue], phase.before[queue + 1]) if r * window >= total else (r * low // total, r * high // total)
        while local < stop:
            r += 1
            if r * window >= total:
                under_next, over_next = phase.before[queue], phase.before[queue + 1]
            else:
                under_next, over_next = r * low // total, r * high // total
            lo, hi = over - under, over_next - under_next
            if hi > local:
                length = (hi if hi < stop else stop) - local
                # in a window the queue's tokens follow those of earlier queues
                out.append((at - start, length, phase.first + r - 1, under_next - under + local - lo))
                local += length
                at += length
            under, over = under_next, over_next
    return out


def encoded(docs: DataFrame, vocabulary: str, end_id: int, remember: int | None = None) -> DataFrame:
    """part, key, run (tokens of the same source before, in this partition), doc_id, source, n, ids of 16 bits."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    end = np.asarray([end_id], "<u2").tobytes()

    def run(batches):  # noqa: ANN001, ANN202
        part, ran = TaskContext.get().partitionId(), {}
        enc = encoder(vocabulary, remember)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [x + end for x in enc.encode([t if t is not None else "" for t in batch.column(1).to_pylist()])]
            sources, runs = batch.column(2).to_pylist(), []
            for s, x in zip(sources, ids, strict=True):
                runs.append(at := ran.get(s, 0))
                ran[s] = at + len(x) // 2
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int64()),
                    pa.array(["" if s is None else "=" + s for s in sources], pa.string()),
                    pa.array(runs, pa.int64()),
                    batch.column(0).cast(pa.int64()),
                    pa.array(sources, pa.string()),
                    pa.array([len(x) // 2 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["part", "key", "run", "doc_id", "source", "n", "ids"],
            )

    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, "part long, key string, run long, doc_id long, source string, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, targets: dict[str | None, float] | None = None, remember: int | None = None) -> DataFrame:
    """One row for each piece of a document: PIECES. targets: the wanted share of tokens by source, by default as they are.

    remember: words whose ids a worker keeps, by default tokens.CACHE_ENTRIES; fewer need less memory and more time, for the same rows.
    """
    table = materialise(encoded(docs, vocabulary or default_vocabulary(), end_id, remember), "encoded")
    runs = materialise(table.groupBy("part", "key").agg(F.sum("n").alias("tokens"), F.first("source").alias("source")), "runs")
    totals = materialise(runs.groupBy("key").agg(F.sum("tokens").alias("tokens")), "queues")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], PIECES)
    # at most `window` sources can hold that much
    wanted = [] if targets is None else ["" if s is None else "=" + s for s in targets]
    large = F.col("tokens") * window >= total
    own = {r["key"]: r["tokens"] for r in totals.filter(large | F.col("key").isin(wanted) if wanted else large).orderBy("key").collect()}
    rest = total - sum(own.values())
    keys = sorted(own)
    lengths = [own[k] for k in keys]
    if rest and rest * window < total and keys and targets is None:
        joined = min(range(len(keys)), key=lengths.__getitem__)  # too few tokens for a queue: they follow the shortest one
    elif rest:
        keys, lengths, joined = [*keys, REST], [*lengths, 0], len(keys)
    else:
        joined = -1
    shift = lengths[joined] if rest else 0
    if rest:
        lengths[joined] += rest
    shares = None
    if targets is not None:
        by_key = {"" if s is None else "=" + s: float(w) for s, w in targets.items()}
        shares = [by_key.get(k, 0.0) for k in keys]
    phases = schedule(lengths, shares, window)
    ends = [[ph.begin[q] + ph.before[q + 1] - ph.before[q] for ph in phases] for q in range(len(keys))]
    # where each partition's run of a source begins in its queue
    spark = docs.sparkSession
    names = spark.createDataFrame([(k, i) for i, k in enumerate(keys) if k != REST], "key string, queue int")
    placed = runs.select("part", "key", "tokens").join(F.broadcast(names), "key", "left")
    single = placed.filter("queue IS NOT NULL").withColumn("base", F.coalesce(F.sum("tokens").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = placed.filter("queue IS NULL").drop("queue")
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = small.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("below", F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    common = small.withColumn("within", within).join(parts, "part").select("part", "key", F.lit(joined).alias("queue"), (F.col("within") + F.col("below") + shift).alias("base"))
    bases = single.select("part", "key", "queue", "base").unionByName(common) if rest else single.select("part", "key", "queue", "base")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut_up: list[tuple] = []
        times, sums = [], []
        for n, ids, queue, start in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
            found = pieces(phases, ends[queue], queue, start, n, window)
            sums += [zlib.crc32(wide[4 * at : 4 * (at + length)]) for at, length, _, _ in found]
            cut_up += found
            times.append(len(found))
        row = pa.array(np.repeat(np.arange(batch.num_rows), times))
        start, length, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*cut_up, strict=True))
        doc_id, source, n = (batch.column(i).take(row) for i in (0, 1, 2))
        return pa.RecordBatch.from_arrays([doc_id, start, length, pa.array(sums, pa.int64()), n, sequence, offset, source], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    if runs.count() <= BROADCAST_RUNS:
        bases = F.broadcast(bases)
    located = table.join(bases, ["part", "key"]).select("doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("run")).alias("start"))
    return arrow_map(located, cut, PIECES)
