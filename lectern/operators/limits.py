"""Sliding-window rate limits: admission depends on the requests admitted before, so it's a fold, not a frame.

A request is admitted when fewer than `times` admitted ones lie in the half-open window (now - seconds, now]; a
refused request leaves no trace and is told when the oldest admitted one leaves the window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Log:
    """The admissions of one key."""

    times: int
    seconds: float
    held: deque = field(default_factory=deque)

    def ask(self, now: float) -> tuple[bool, float | None]:
        while self.held and self.held[0] <= now - self.seconds:
            self.held.popleft()
        if len(self.held) >= self.times:
            return False, self.held[0] + self.seconds - now
        self.held.append(now)
        return True, None


# Times and seconds of each bucket.
BUCKETS = {"chat": (20, 60), "upload": (10, 60), "register": (5, 3600), "login": (10, 60), "external": (3, 3600)}

OUT = "key string, event_id long, ts double, admitted boolean, retry_after double"


def limited(requests: DataFrame) -> DataFrame:
    """requests (key, event_id, ts in seconds, times, seconds) -> OUT, each key in order of ts and event_id.

    Rows of a key stream through in batches: only the admissions inside the window are held. A key is inherently one
    sequence; whole buckets are not: keys hold the bucket and the caller.
    """
    rows = requests.select("key", "event_id", "ts", "times", "seconds")
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, None
        for batch in batches:
            admitted, retry = [], []
            for k, ts, times, seconds in zip(batch["key"], batch["ts"], batch["times"], batch["seconds"], strict=True):
                if log is None or k != key:
                    key, log = k, Log(int(times), float(seconds))
                ok, wait = log.ask(ts)
                admitted.append(ok)
                retry.append(wait)
            out = batch[["key", "event_id", "ts"]].copy()
            out["admitted"], out["retry_after"] = admitted, pd.array(retry, "float64")
            yield out

    return ordered.mapInPandas(run, OUT)


def retry_seconds(wait: Column) -> Column:
    """Whole seconds to wait, at least one."""
    return F.greatest(F.lit(1), F.floor(wait + 0.999).cast("int"))
