"""Answers that fail over, and jobs with leases: by example, by replay as a stream in another order, and at the edges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import machines, rerank
from lectern.operators.machines import Answer, Job
from lectern.streaming.machines import folded_stream

SCHEMA = "key string, event_id long, at long, kind string, actor string, data string"
CHAIN = ("a", "b", "c")


def told(machine, events):
    out = [t for e in events for t in machine.feed(*e)]
    return [(t[0], *t[2:]) for t in out + machine.idle(None)]


def test_an_error_before_the_first_token_falls_over():
    got = told(Answer(CHAIN, 100), [(1, 0, "error", "a", "down"), (2, 5, "token", "b", "x"), (3, 6, "token", "a", "late"), (4, 9, "end", "b", None)])
    assert got == [("token", "b", 1, 5, "x"), ("completed", "b", 1, 9, None)]


def test_an_error_after_a_token_is_passed_on():
    got = told(Answer(CHAIN, 100), [(1, 0, "token", "a", "x"), (2, 5, "error", "a", "cut"), (3, 6, "token", "b", "y")])
    assert got == [("token", "a", 1, 0, "x"), ("broken", "a", 1, 5, "cut")]


def test_silence_counts_as_an_error():
    # b is silent from 100, c from 200: its token at 200 is in time for c alone
    assert told(Answer(CHAIN, 100), [(1, 0, None, None, None), (2, 201, "token", "c", "x")]) == [("token", "c", 1, 201, "x"), ("broken", "c", 1, 301, "no answer in time")]
    assert told(Answer(CHAIN, 100), [(1, 0, "start", None, None), (2, 100, "token", "a", "x")])[0] == ("token", "a", 1, 100, "x")
    assert told(Answer(CHAIN, 100), [(1, 0, "start", None, None), (2, 400, "token", "a", "x")]) == [("failed", None, 0, 300, "no answer in time")]


def test_no_provider_is_a_failure():
    assert told(Answer((), 100), [(1, 3, "token", "a", "x"), (2, 4, "end", "a", None)]) == [("failed", None, 0, 3, "no provider is configured")]
    assert told(Answer(CHAIN, 100), [(i, i, "error", p, p) for i, p in enumerate(CHAIN)]) == [("failed", None, 0, 2, "c")]


def test_jobs():
    lost = [(1, 0, "claim", "w", None), (2, 5, "claim", "v", None), (3, 9, "beat", "w", None), (4, 15, "beat", "v", None), (5, 30, "completed", "w", "late"), (6, 31, "claim", "v", None), (7, 32, "completed", "v", "ok"), (8, 33, "failed", "v", "no")]
    assert told(Job(10, 3), lost) == [("claimed", "w", 1, 0, None), ("expired", "w", 1, 19, None), ("claimed", "v", 2, 31, None), ("completed", "v", 2, 32, "ok")]
    assert told(Job(10, 1), [(1, 0, "claim", "w", None)]) == [("claimed", "w", 1, 0, None), ("expired", "w", 1, 10, None), ("failed", None, 1, 10, "no worker finished in time")]
    assert told(Job(10, 1), [(1, 0, "completed", "w", None)]) == []


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("machine", [Answer(("p0", "p1", "p2"), 86_400_000_000), Job(43_200_000_000, 3)], ids=["answers", "jobs"])
def test_a_stream_tells_what_the_table_does(spark, data, tmp_path, machine):
    kinds = {"error": "error", "signup": "end", "click": "token"} if isinstance(machine, Answer) else {"click": "claim", "signup": "claim", "view": "beat", "purchase": "completed", "error": "failed"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    actor = F.concat(F.lit("p" if isinstance(machine, Answer) else "w"), F.pmod("event_id", F.lit(3)).cast("string"))
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", F.col("user_id") % 40, F.dayofmonth("ts")).alias("key"), "event_id", names[F.col("event_type")].alias("kind"), actor.alias("actor"), F.col("props").alias("data"))
    expected = rows(machines.folded(machines.events_of(events, key="key", event_id="event_id", at="ts", kind="kind", actor="actor", data="data"), machine))
    # out of order by less than the delay, a third of all rows twice; at last something that lets the watermark pass everything
    folder, schema = str(tmp_path / "in"), events.schema
    moved = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(20 * 3_600_000_000))
    sent = events.unionByName(events.filter("event_id % 3 = 0")).withColumn("file", F.ntile(6).over(Window.orderBy(moved)))
    for i in range(1, 7):
        sent.filter(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(folder)
    last = events.limit(1).select(F.expr("timestamp'2034-01-01'").alias("ts"), F.lit("last").alias("key"), F.lit(-1).cast("long").alias("event_id"), *[F.lit(None).cast("string").alias(c) for c in ("kind", "actor", "data")])
    last.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    run = folded_stream(stream, machine, "30 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination(600)
    assert run.exception() is None
    assert rows(spark.read.parquet(out).filter("key <> 'last'")) == expected


def test_machines_of_nothing_and_of_nulls(spark):
    made = spark.createDataFrame([(None, 1, 1, "token", "a", "x"), ("k", None, 1, "token", "a", "x"), ("k", 1, None, "token", "a", "x"), ("m", 1, 1, None, None, None)], SCHEMA)
    got = machines.folded(made.withColumn("n", F.lit(1)).withColumn("event", F.lit(1)), Answer(CHAIN, 10)).collect()
    assert [tuple(r) for r in got] == [("m", "failed", None, None, 0, 31, "no answer in time")]
    assert machines.folded(made.limit(0), Job(10, 1)).count() == 0


def test_late_interaction(spark):
    made = spark.createDataFrame([(1, "lung nodules", "a nodule of the lung"), (2, "lung nodules", "heart failure"), (3, None, "x"), (4, "lung", None), (5, "lung", "lung " * 5000 + "nodule")], "i int, question string, text string")
    got = {r["i"]: r["rerank_score"] for r in rerank.reranked(made).collect()}
    assert got[1] > 1.5 > got[2] and got[3] is None and got[4] is None and got[5] == 1.0

    class Broken:
        def vectors(self, words):
            raise RuntimeError("no model")

    assert [r["rerank_score"] for r in rerank.reranked(made, Broken()).collect()] == [None] * 5


def test_words_in_blocks():
    words, own = [f"word{i}x" for i in range(5000)], rerank.TrigramEmbedder()
    assert rerank.interaction(["word4999x", "other"], words, own) == pytest.approx(1 + max(rerank.interaction(["other"], [w], own) for w in words))
