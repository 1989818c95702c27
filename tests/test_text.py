import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The Pleural line, a lung-edge in 2 CT views!", ["pleural", "line", "lung", "edge", "ct", "views"]),
        ("", []),
        (None, []),
        ("no no", ["no", "no"]),
    ],
)
def test_tokenize(spark, text, expected):
    assert one(spark, T.tokenize(F.col("t")), t=text) == expected


def test_scope_needs_a_pattern_and_no_vocabulary(spark):
    asked = ["What's the weather like?", "weather after chest trauma", "design weather", "tell me a joke", "stroke"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", T.out_of_scope(F.col("q")).alias("out")).collect()
    # "sign" in "design" keeps a query in scope
    assert [r["out"] for r in rows] == [True, False, False, True, False]


def test_citations(spark):
    assert one(spark, T.plain_citations(F.col("t")), t="see 【1】 and ［2］") == "see [1] and [2]"
    for inside, valid in (("1, 3", True), ("0", False), ("4", False), ("x", False), ("1,", False)):
        assert one(spark, T.citation_valid(F.col("t"), F.lit(3)), t=inside) is valid


def test_jaccard_and_agreement(spark):
    assert one(spark, T.agreement(F.col("a"), F.col("b")), a="one two", b="two three") == 0.5
    assert one(spark, T.agreement(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, T.agreement(F.col("a"), F.col("b")), a="x", b=None) == 0.0


def test_contextualise(spark):
    assert one(spark, T.contextualise(F.col("t"), F.col("f"), F.lit("c")), t=" Title ", f="x.txt") == "Title. c"
    assert one(spark, T.contextualise(F.col("t"), F.col("f"), F.lit("c")), t=" ", f="x.txt") == "x.txt. c"
    assert one(spark, T.contextualise(F.col("t"), F.col("f"), F.lit("c")), t=None, f=None) == "c"


def test_replies(spark):
    for reply, text in (('```json\n{"transcription": "a"}\n```', "a"), ('Here: {"transcription": "b", "unclear": []} ok', "b"), ("just text", "just text")):
        assert one(spark, T.parse_reply(F.col("t")), t=reply)["transcription"] == text


def test_events_round_trip(spark):
    frame = T.stream_event(F.lit("token"), F.col("t"))
    got = one(spark, T.stream_decode(frame), t='{"a": 1}')
    assert (got["event"], got["data"]) == ("token", '{"a": 1}')
