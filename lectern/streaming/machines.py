"""Answers and jobs as a stream: each key's machine is keyed state, its deadline an event-time timer.

Events wait in the state until the watermark passes them and then go to the machine in order of time and id, so a stream that is
late by less than the watermark's delay tells what the whole table does. Events later than that are dropped. A key whose machine has
ended stays for `keep` microseconds, so that stragglers meet the end, and is forgotten then: keys aren't to be used again.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.machines import EVENT, OUT, Answer, Job, frame
from lectern.streaming.limiter import ROCKSDB

NAMES = [c.split()[0] for c in OUT.split(", ")]
DAY = 86_400_000_000


class Machines(StatefulProcessor):
    def __init__(self, machine: Answer | Job, keep: int):
        self.machine, self.keep = machine, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long, kind string, actor string, data string")
        # the machine's fields and the last event it has taken
        self.state = handle.getValueState("machine", "fields string, at long, event_id long")

    def _wake(self, at: int) -> None:
        # timers have whole milliseconds and go off when the watermark has passed them
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()
        taken = (last[1], last[2]) if last is not None else None
        new = [r for batch in rows for r in zip(*(batch[c].tolist() for c in EVENT[1:]), strict=True)]
        new = [r for r in new if taken is None or (r[1], r[0]) > taken]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[1] for r in new))
        yield frame([], NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.state.get()
        own = dataclasses.replace(self.machine, **(json.loads(last[0]) if last is not None else {}))
        if isinstance(own, Answer):
            own.providers = tuple(own.providers)
        taken = (last[1], last[2]) if last is not None else (None, None)
        told: list[tuple[Any, ...]] = []
        # repeated events are neighbours in this order
        waiting = sorted({(r[1], r[0]): tuple(r) for r in self.waiting.get()}.items())
        for (at, event_id), row in waiting:
            if at < passed:
                told += own.feed(event_id, at, *row[2:])
                taken = (at, event_id)
        told += own.idle(passed)
        later = [row for (at, _), row in waiting if at >= passed]
        if own.ended is not None and not later and own.ended + self.keep < passed:
            self.waiting.clear()
            self.state.clear()
        else:
            self.state.update((json.dumps(dataclasses.asdict(own)), *taken))
            if later:
                self.waiting.put(later)
                self._wake(later[0][1])
            else:
                self.waiting.clear()
            due = own.deadline if own.ended is None else own.ended + self.keep
            if due is not None:
                self._wake(max(due, passed))
        yield frame([(key[0], *t) for t in told], NAMES)

    def close(self) -> None:
        pass


def folded_stream(events: DataFrame, machine: Answer | Job, delay: str, keep: int = DAY) -> DataFrame:
    """A streaming DataFrame (ts timestamp, and EVENT without at) -> OUT. The RocksDB state store stays set for the session, since it counts when the query starts."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.filter("key IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("ts", "key", "event_id", F.unix_micros("ts").alias("at"), "kind", "actor", "data")
    return rows.groupBy("key").transformWithStateInPandas(Machines(machine, keep), OUT, "append", "EventTime")
