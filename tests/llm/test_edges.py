"""Every operator and stage with empty tables, very long texts, and further columns whose names clash with its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import ann, bpe_codec, chat_tree, exact_dedup, line_dedup, packing, simhash, token_file, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(" ".join(f"w{(i * 7 + j) % 997}" for j in range(20)) for i in range(3000))
ROWS = [
    (None, "no id at all here", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "one two three four five six", "en", "s", 27),
    (4, "one two three four five six", "en", "t", 27),
    (4, "one two three four five six", "en", "t", 27),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG + " more", "en", "s", len(LONG)),
    (7, "x" * 50_000, "en", "t", 50_000),
]
#: Names that the operators use themselves.
NAMES = ["id", "key", "n", "part", "line", "line_no", "class", "root", "fp", "node", "rank", "first", "digest", "ids", "tokens", "queue", "run", "start", "label", "text_key", "list", "codes", "__doc", "__text", "__part", "__parts", "TAIL", "node_", "r", "tainted"]


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, toxic int")


def stored(spark, docs, tmp):
    path = f"{tmp}/documents.parquet"
    docs.write.parquet(path)
    return path


OPERATORS = {
    "op1": lambda s, d, t: line_dedup.classes(d),
    "op2": lambda s, d, t: bpe_codec.encode_decode(d),
    "op3": lambda s, d, t: toxicity.score(d, toxicity.train(d, labels(s))),
    "op4": lambda s, d, t: packing.pack(d.coalesce(1)),
    "op6": lambda s, d, t: simhash.near_duplicates(d),
    "op9": lambda s, d, t: token_file.round_trip(d, s),
    "op10": lambda s, d, t: exact_dedup.deduplicate(s, stored(s, d, t)),
}


def shown(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, tmp_path, name):
    docs = spark.createDataFrame(ROWS, DOC).coalesce(1)
    clashing = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    run = OPERATORS[name]
    plain = shown(run(spark, docs, tmp_path / "a"))
    assert shown(run(spark, clashing, tmp_path / "b")) == plain
    if name in ("op2", "op3", "op6", "op9", "op10"):
        assert len(plain) == len(ROWS)
    assert run(spark, clashing.limit(0), tmp_path / "c").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(ROWS, DOC).coalesce(1)
    clashing = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    out = stage(spark, clashing, str(tmp_path))
    own = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == clashing.columns and own.columns == docs.columns
        assert out.select(*NAMES).distinct().count() == 1
    assert shown(out.select(*own.columns)) == shown(own)
    empty = stage(spark, clashing.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "line_dedup":
        texts = [r["text"] for r in own.collect()]
        # the long text keeps the first of its equal lines, its copy none but perhaps the changed one
        assert len(texts) == len(ROWS) and "\n".join(dict.fromkeys(LONG.split("\n"))) in texts and None in texts
        assert sum(len(t or "") > 1000 for t in texts) == 2 and "x" * 50_000 in texts
    if name == "simhash":
        kept = [r["doc_id"] for r in own.collect()]
        assert sorted(kept, key=lambda x: (x is None, x)) == [1, 3, 5, 7, None]


def test_urls(spark):
    rows = [(1, "http://a.com/en/1", "<link rel=canonical href='/x'>"), (None, "http://a.com/x", None), (2, None, ""), (3, "http://b.fr/" + "x" * 20_000, "<p>" * 100_000 + "<link rel=canonical href=//a.com/en/1>"), (1, "http://a.com/en/1", "<link rel=canonical href='/x'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = pages.select("*", *[F.lit(i).alias(n) for i, n in enumerate([*NAMES, "host", "path", "rule", "verdict", "from_url", "to_url", "target"])])
    plain = shown(url_filter.judge(pages))
    assert shown(url_filter.judge(clashing)) == plain
    assert sorted(str((r["page_id"], r["verdict"])) for r in url_filter.judge(pages).collect()) == sorted(map(str, [(1, "block"), (1, "block"), (None, "block"), (2, "allow"), (3, "block")]))
    assert url_filter.judge(clashing.limit(0)).count() == 0


def test_conversations(spark):
    turns = 250
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i % 3}") for i in range(turns)] + [(2, 0, "user", LONG), (2, 1, "assistant", None), (None, None, None, None), (3, 0, "user", "turn 0")]
    kind = "conv_id long, turn long, role string, text string"
    conversations = spark.createDataFrame(rows, kind)
    clashing = conversations.select("*", *[F.lit(i).alias(n) for i, n in enumerate([*NAMES, "sort", "paths", "turns", "roles", "texts", "depth", "parent", "offset"])])
    read = lambda c: chat_tree.read_back(*chat_tree.tree(c))
    plain = shown(read(conversations))
    assert shown(read(clashing)) == plain
    got = {r["conv_id"]: r for r in read(conversations).collect()}
    assert got.keys() == {1, 2, 3, None} and got[1]["n_turns"] == turns and got[1]["loss_chars"] == turns // 2 * 6
    assert chat_tree.tree(clashing)[0].count() == turns + 2 + 1
    assert read(clashing.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(20, rng.normal(size=8).tolist()), (None, [1.0] * 8), (40, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clashing = vectors.select("*", *[F.lit(i).alias(n) for i, n in enumerate([*NAMES, "v", "q", "query_id", "score", "askers", "block"])])
    plain = shown(ann.search(vectors))
    assert shown(ann.search(clashing)) == plain and len(plain) == 6 * 20
    assert not any(r["vec_id"] == r["query_id"] for r in ann.search(vectors).collect())
    # lists that hold too few candidates are no reason for a short answer
    few = ann.search(vectors, k=100)
    assert few.count() == 6 * 100
    assert ann.search(clashing.limit(0)).count() == 0


def test_a_query_whose_lists_hold_too_few_asks_all(spark, monkeypatch):
    """Far lists of few vectors: every query still gets its twenty."""
    monkeypatch.setattr(ann, "PROBE_LEAST", 1)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(5, 4)) * 0.01 + 10 * c for c in np.eye(4) for _ in (0, 1)] + [rng.normal(size=(200, 4)) * 0.01])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, recall=0.01).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert len(got) == -(-len(x) // 20) and all(r["n"] == 20 for r in got)
