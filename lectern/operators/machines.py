"""Sequences of events with deadlines: answers that fail over between providers, and jobs with leases.

A machine takes the events of one key in order of time and id and tells what they change; silence beyond its deadline changes
it too. Here a whole table is folded; `lectern.streaming.machines` folds a stream by the same machines.

Nulls: events without key, time or id are left out, events of another kind change nothing. Repeated events (one key, time and id)
count once. An empty table gives an empty one; further columns aren't read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: key, event_id, at (microseconds), kind, actor, data
EVENT = ("key", "event_id", "at", "kind", "actor", "data")
OUT = "key string, event string, event_id long, actor string, n long, at long, data string"

#: What a machine tells: event, event_id, actor, n, at, data.
Told = tuple[str, int | None, str | None, int, int, str | None]


@dataclass
class Answer:
    """One answer from a chain of providers, of which the first that gives a token is the only one to be heard.

    A provider that fails, or says nothing for `timeout` microseconds, before its first token gives way to the next one. After the
    first token its failure is the answer's: two providers' words are never put together. Events of providers whose turn it isn't,
    and of an answer that has ended, change nothing. Told: each token; then completed, broken (after tokens) or failed (no
    provider left), with the number of tokens and the last error.
    """

    providers: tuple[str, ...]
    timeout: int
    turn: int = 0
    tokens: int = 0
    since: int | None = None
    error: str | None = None
    ended: int | None = None

    @property
    def deadline(self) -> int | None:
        return self.since + self.timeout if self.since is not None and self.ended is None else None

    def _end(self, event: str, event_id: int | None, at: int) -> list[Told]:
        self.ended = at
        actor = self.providers[self.turn] if self.turn < len(self.providers) else None
        return [(event, event_id, actor, self.tokens, at, None if event == "completed" else self.error)]

    def _fail(self, event_id: int | None, at: int, error: str | None) -> list[Told]:
        self.error, self.since = error, at
        if self.tokens:
            return self._end("broken", event_id, at)
        self.turn += 1
        return self._end("failed", event_id, at) if self.turn >= len(self.providers) else []

    def idle(self, until: int | None) -> list[Told]:
        """What silence up to `until` (null: for ever) changes."""
        told: list[Told] = []
        while (due := self.deadline) is not None and (until is None or due < until):
            told += self._fail(None, due, "no answer in time")
        return told

    def feed(self, event_id: int, at: int, kind: str | None, actor: str | None, data: str | None) -> list[Told]:
        if self.since is None:
            self.since = at
            if not self.providers:
                self.error = "no provider is configured"
                return self._end("failed", event_id, at)
        told = self.idle(at)
        if self.ended is not None or actor != self.providers[self.turn]:
            return told
        if kind == "token":
            self.tokens, self.since = self.tokens + 1, at
            told.append(("token", event_id, actor, self.tokens, at, data))
        elif kind == "error":
            told += self._fail(event_id, at, data)
        elif kind == "end":
            told += self._end("completed", event_id, at)
        return told


@dataclass
class Job:
    """A background job that workers claim for `lease` microseconds at a time.

    A queued job goes to the first who claims it; each beat of the holder renews the lease. A lease that runs out puts the
    job back, `attempts` times at most, then it has failed. What the holder reports, completed or failed, is the outcome and is
    recorded once; whatever others report, or anybody after the end, changes nothing. Told: claimed, expired, completed,
    failed, with the number of the attempt.
    """

    lease: int
    attempts: int
    attempt: int = 0
    holder: str | None = None
    held: bool = False
    until: int = 0
    ended: int | None = None

    @property
    def deadline(self) -> int | None:
        return self.until if self.held and self.ended is None else None

    def idle(self, until: int | None) -> list[Told]:
        due = self.deadline
        if due is None or (until is not None and due >= until):
            return []
        holder, self.holder, self.held = self.holder, None, False
        told: list[Told] = [("expired", None, holder, self.attempt, due, None)]
        if self.attempt >= self.attempts:
            self.ended = due
            told.append(("failed", None, None, self.attempt, due, "no worker finished in time"))
        return told

    def feed(self, event_id: int, at: int, kind: str | None, actor: str | None, data: str | None) -> list[Told]:
        told = self.idle(at)
        if self.ended is not None:
            return told
        if kind == "claim" and not self.held:
            self.attempt, self.holder, self.held, self.until = self.attempt + 1, actor, True, at + self.lease
            told.append(("claimed", event_id, actor, self.attempt, at, None))
        elif self.held and actor == self.holder:
            if kind == "beat":
                self.until = at + self.lease
            elif kind in ("completed", "failed"):
                self.ended, self.held = at, False
                told.append((kind, event_id, actor, self.attempt, at, data))
        return told


def folded(events: DataFrame, machine: Answer | Job) -> DataFrame:
    """events (EVENT) -> OUT: each key in order of at and event_id, with a copy of the machine; after its last event there is silence.

    A key's events stream through in batches and only the machine is held. A key is inherently one sequence.
    """
    rows = events.select(*EVENT).filter("key IS NOT NULL AND at IS NOT NULL AND event_id IS NOT NULL")
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, last = None, None, None
        for batch in batches:
            told: list[tuple[Any, ...]] = []
            for k, event_id, at, kind, actor, data in zip(*(batch[c].tolist() for c in EVENT), strict=True):
                if own is None or k != key:
                    if own is not None:
                        told += [(key, *t) for t in own.idle(None)]
                    key, own, last = k, dataclasses.replace(machine), None
                if (at, event_id) != last:
                    last = (at, event_id)
                    told += [(key, *t) for t in own.feed(event_id, at, kind, actor, data)]
            yield frame(told, names)
        if own is not None:
            yield frame([(key, *t) for t in own.idle(None)], names)

    return ordered.mapInPandas(run, OUT)


def frame(told: list[tuple[Any, ...]], names: list[str]) -> pd.DataFrame:
    """Rows as a frame whose whole numbers may be null."""
    return pd.DataFrame(told, columns=names).astype({"event_id": "Int64", "n": "int64", "at": "int64"})


def events_of(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """rows as EVENT, with the expressions given for its columns; at may be a timestamp."""
    out = rows.select(*[(F.col(e) if isinstance(e := columns[c], str) else e).alias(c) for c in EVENT])
    return out.withColumn("at", F.unix_micros("at")) if dict(out.dtypes)["at"] == "timestamp" else out
