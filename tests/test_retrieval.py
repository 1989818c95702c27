from pyspark.sql import functions as F

from lectern.operators import lexical, retrieval, vector

CORPUS = [
    ("p1", "Pneumothorax shows a visceral pleural line without lung markings beyond it."),
    ("p2", "Pneumothorax pneumothorax pneumothorax after liposuction."),
    ("p3", "Pneumothorax in intensive care: pneumothorax imaging."),
    ("p4", "Knee arthroplasty and its complications."),
]
HIT = "query_id int, rank int, document_id string, chunk_index int, text string, score double, point_id string"


def search(spark, question, top=20):
    index = lexical.build(spark.createDataFrame(CORPUS, "id string, text string"), "id")
    queries = spark.createDataFrame([(0, question)], "item_id int, text string")
    return lexical.search(index, queries, top=top).orderBy("rank").collect()


def test_explaining_passage_beats_dense_ones(spark):
    found = search(spark, "visceral pleural line lung markings")
    assert found[0]["id"] == "p1"
    assert all(r["bm25_score"] > 0 for r in found)
    assert "p4" not in {r["id"] for r in search(spark, "pneumothorax")}
    assert search(spark, "unknownword") == []


def test_salient_terms_prefer_rare_ones(spark):
    index = lexical.build(spark.createDataFrame(CORPUS, "id string, text string"), "id")
    texts = spark.createDataFrame([(1, "pneumothorax knee garbledxyz")], "item_id int, text string")
    assert [r["term"] for r in lexical.salient(index, texts, "item_id").orderBy("rank").collect()] == ["knee", "pneumothorax"]


def test_bm25_matches_plain_python(spark):
    import math

    docs = {i: [w for w in t.lower().replace(".", "").replace(":", "").split() if len(w) > 1 and w not in set("a an and its it in".split())] for i, t in CORPUS}
    terms = ["pneumothorax", "imaging"]
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    expected = {}
    for i, words in docs.items():
        s = 0.0
        for t in terms:
            df = sum(t in w for w in docs.values())
            tf = words.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
        expected[i] = round(s, 4)
    got = {r["id"]: r["bm25_score"] for r in search(spark, "pneumothorax imaging")}
    assert got == {i: s for i, s in expected.items() if s > 0}


def hits(spark, rows):
    return spark.createDataFrame([(0, i + 1, d, c, t, s, f"p{i}") for i, (d, c, t, s) in enumerate(rows)], HIT)


def test_cap_keeps_rank_order_and_spares_rows_without_document(spark):
    rows = hits(spark, [("a", 0, "x", 0.9)] * 5 + [(None, 0, "y", 0.8)] * 5)
    assert retrieval.cap_per_document(rows).count() == 8
    assert retrieval.cap_per_document(rows, 0).count() == 10


def test_adjacent_chunks_merge_without_repeating_the_overlap(spark):
    shared = "this overlap is long enough to be seen"
    rows = hits(spark, [("a", 1, shared + " second", 0.5), ("a", 0, "first " + shared, 0.7), ("a", 3, "apart", 0.9), ("b", 2, "other", 0.1)])
    found = retrieval.merge_adjacent(rows).orderBy("chunk_id").collect()
    assert [r["text"] for r in found] == ["apart", f"first {shared} second", "other"]
    assert [r["score"] for r in found] == [0.9, 0.7, 0.1]
    assert found[1]["chunk_index"] == 1
    assert [r["chunk_id"] for r in found] == [1, 2, 3]


def test_short_overlaps_are_not_stitched(spark):
    row = spark.range(1).select(retrieval.stitch(F.lit("abc def"), F.lit("def ghi")).alias("x")).first()
    assert row["x"] == "abc def\ndef ghi"


def test_union_prefers_vector_hits(spark):
    near = spark.createDataFrame([(0, "a", 0.9)], "query_id int, point_id string, score double")
    words = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c")], "query_id int, point_id string")
    cosines = spark.createDataFrame([(0, "b", 0.4)], "query_id int, point_id string, score double")
    got = {r["point_id"]: r["score"] for r in retrieval.unite(near, words, cosines).collect()}
    assert got == {"a": 0.9, "b": 0.4, "c": 0.0}


def test_vector_filter_applies_before_the_cut(spark):
    points = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(10)], "vec_id int, embedding array<float>, label int")
    got = vector.search(points, [0.0, 1.0], limit=2, where=F.col("label") == 1).collect()
    assert [r["vec_id"] for r in got] == [9, 7]


def test_gate_is_inclusive(spark):
    rows = spark.createDataFrame([(0, 0.35), (1, 0.349)], "q int, score double")
    assert {r["q"]: r["relevant"] for r in vector.relevant(rows, ["q"]).collect()} == {0: True, 1: False}


def test_hybrid_search_numbers_passages(spark):
    from lectern.plans import ingest, search as plan

    docs = spark.createDataFrame([(i, f"{t} " * 3, "kb", "Title", None) for i, t in CORPUS], "document_id string, text string, source_type string, title string, filename string")
    points = ingest.points(docs, vector.HashingEmbedder(64))
    questions = spark.createDataFrame([(0, "visceral pleural line")], "query_id int, text string")
    found = plan.retrieve(points, questions, vector.HashingEmbedder(64)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in found] == list(range(1, len(found) + 1))
    assert "p1" in {r["document_id"] for r in found}


def test_hybrid_search_query_has_the_default_dimensions(spark, data, monkeypatch):
    from lectern.plans import queries, search as plan

    seen = []
    retrieve = plan.retrieve
    monkeypatch.setattr(plan, "retrieve", lambda points, questions, embedder, **more: seen.append(embedder.dim) or retrieve(points, questions, embedder, **more))
    assert queries.QUERIES["hybrid_search"](spark, data).columns
    assert seen == [vector.HashingEmbedder().dim]


def test_phrases_are_found_under_their_words(spark):
    from lectern.operators import evaluate

    corpus = spark.createDataFrame([(1, "The Pleural line is seen."), (2, "x-ray of the knee"), (3, None), (4, "preCTinal")], "doc_id int, text string")
    wanted = ["pleural LINE is", "he pleural line i", "ct", "ray", "knee jerk", "the", None, "line  is", "of the kn"]
    phrases = spark.createDataFrame([(p,) for p in wanted], "phrase string")
    texts = [t.lower() for t in ("The Pleural line is seen.", "x-ray of the knee", "preCTinal")]
    found = {r["phrase"] for r in evaluate.containing(phrases, corpus, "doc_id").collect()}
    assert found == {p for p in wanted if p and any(p.lower() in t for t in texts)}


def test_questions_in_blocks_find_the_same(spark, monkeypatch):
    import numpy as np

    from lectern.plans import search as plan

    rng = np.random.default_rng(8)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=6))
    points = spark.createDataFrame([(f"p{i:03}", unit(), "a" if i % 2 else "b") for i in range(200)], "point_id string, embedding array<float>, source_type string").repartition(5)
    queries = spark.createDataFrame([(i, unit()) for i in range(9)], "query_id int, embedding array<float>")
    p, q = ({r[0]: np.array(r["embedding"], float) for r in x.collect()} for x in (points, queries))
    for block, source in ((4096, None), (2, None), (4, "a")):
        monkeypatch.setattr(plan, "BLOCK", block)
        got = {}
        for r in plan.vector_hits(points, queries, 7, source).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((r["point_id"], r["score"]))
        own = [i for i in p if source is None or int(i[1:]) % 2]
        for i, v in q.items():
            best = sorted(((round(float(v @ p[j]), 4), j) for j in own), key=lambda x: (-x[0], x[1]))
            assert got[i] == [(j, s) for s, j in best if s >= 0][:7]


def test_texts_scanned_for_questions_give_what_an_index_does(spark, monkeypatch):
    """Without an index, in blocks of any size: the same chunks, scores and order among ties, and postings of the questions' terms alone are written."""
    import random

    rng = random.Random(3)
    words = ["pleural", "line", "the", "knee", "ct", "mr", "\u00fcbel", "x1", "lung", "hilum"]
    chunks = [(f"c{i:03}", rng.choice([None, "", "the of", *[" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(9)]])) for i in range(300)]
    asked = [(i, rng.choice([None, "of the", *[" ".join(rng.choices([*words, "absent"], k=4)) for _ in range(9)]])) for i in range(23)]
    frame = spark.createDataFrame(chunks, "id string, text string").repartition(3)
    queries = spark.createDataFrame(asked, "item_id int, text string")
    expected = sorted(map(tuple, lexical.search(lexical.build(frame, "id"), queries, top=7).collect()))
    assert len(expected) > 50
    written, write = [], lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, tag: written.append(write(df, tag)) or written[-1])
    for questions, rows, postings, common in ((512, 2048, 1 << 18, 8), (5, 7, 11, 2), (1, 1, 1, 100)):
        for name, value in (("QUESTIONS", questions), ("CHUNKS", rows), ("POSTINGS", postings), ("COMMON", common)):
            monkeypatch.setattr(lexical, name, value)
        assert sorted(map(tuple, lexical.scan(frame, "id", "text", queries, top=7).collect())) == expected
    terms = len({t for _, q in asked for t in (q or "").split() if t not in ("of", "the", "\u00fcbel")} | {"bel"})
    assert all(0 <= t < terms for r in written[0].collect() for t in r["terms"])
    for none in (queries.filter("item_id < 0"), queries.filter("text IS NULL")):
        assert lexical.scan(frame, "id", "text", none).collect() == []
    assert lexical.scan(frame.filter("id IS NULL"), "id", "text", queries).collect() == []


def test_search_stores_no_vectors_of_all_points(spark, data, monkeypatch):
    """Vectors and postings of every chunk were several times the input on disk: only what is found is stored with its vector."""
    from lectern.plans import queries, search as plan

    written, write = [], plan.materialise
    record = lambda df, tag: written.append((tag, df.columns)) or write(df, tag)
    for module in (plan, queries, lexical):
        monkeypatch.setattr(module, "materialise", record)
    queries.QUERIES["hybrid_search"](spark, data).collect()
    assert {tag for tag, columns in written if "embedding" in columns} == {"questions", "passages"}
    assert "postings" not in dict(written) and not {"search_text", "point_id"} & set(dict(written)["chunks"])


def test_points_embedded_as_they_pass_give_what_stored_vectors_do(spark):
    from lectern.plans import ingest, search as plan

    docs = spark.createDataFrame([(i, f"{t} " * 9, "kb" if i != "p2" else "other", "Title", None) for i, t in CORPUS], "document_id string, text string, source_type string, title string, filename string")
    questions = spark.createDataFrame([(0, "visceral pleural line"), (1, "knee"), (2, "pneumothorax imaging")], "query_id int, text string")
    stored, bare = ingest.points(docs, vector.HashingEmbedder(64), 90, 20), ingest.searchable(ingest.chunks(docs, 90, 20))
    index = lexical.build(stored, "point_id", "search_text").stored()
    for more in ({}, {"source_type": "kb"}):
        rows = [sorted(map(tuple, plan.retrieve(p, questions, vector.HashingEmbedder(64), index=i, **more).collect()), key=str) for p, i in ((stored, index), (bare, None), (stored, None))]
        assert rows[0] == rows[1] == rows[2] and rows[0]


def test_reranked_search_stores_no_vectors_of_all_points(spark, data, monkeypatch):
    from lectern.plans import queries, search as plan

    written, write = [], plan.materialise
    record = lambda df, tag: written.append((tag, df.columns)) or write(df, tag)
    for module in (plan, queries, lexical):
        monkeypatch.setattr(module, "materialise", record)
    assert queries.QUERIES["hybrid_search_reranked"](spark, data).collect()
    assert {tag for tag, columns in written if "embedding" in columns} == {"questions", "passages"} and "postings" not in dict(written)
