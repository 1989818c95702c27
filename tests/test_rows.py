import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluate, imaging, limits, metadata
from lectern.sources import files, markup


def test_review_guards_approved_rows(spark):
    kind = "report_id int, status string, edited_text string, reviewer string"
    reports = spark.createDataFrame([(1, "approved", "a", "x"), (2, "draft", None, None), (3, "approved", "c", "x")], kind)
    changes = spark.createDataFrame([(1, "rejected", "new", "y"), (2, "approved", "b", "y"), (3, "draft", None, "y")], kind)
    got = {r["report_id"]: tuple(r)[1:] for r in metadata.review(reports, changes).collect()}
    assert got == {1: ("approved", "a", "x"), 2: ("approved", "b", "y"), 3: ("draft", "c", None)}


def test_pages(spark):
    rows = spark.range(10)
    assert [r[0] for r in metadata.page(rows, 2, 3, F.desc("id")).collect()] == [6, 5, 4]
    with pytest.raises(ValueError):
        metadata.page(rows, 0, 3, "id")


def test_anti_join_takes_each_new_key_once(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "title string, source_type int")
    stored = spark.createDataFrame([("b", 1)], "title string, source_type int")
    assert [tuple(r) for r in metadata.missing(new, stored, ["title", "source_type"]).collect()] == [("a", 1)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "document_id string, chunk_index int, text string")
    new = spark.createDataFrame([("a", 0, "new")], old.schema)
    once = metadata.replace_documents(old, new)
    twice = metadata.replace_documents(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 0, "new"), ("b", 0, "z")]


def test_limiter_forgets_refusals_and_has_a_half_open_window(spark):
    times = [0.0, 10.0, 20.0, 59.0, 60.0, 69.0, 70.0]
    rows = spark.createDataFrame([("k", i, t, 2, 60.0) for i, t in enumerate(times)], "key string, event_id int, ts double, times int, seconds double")
    got = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in limits.limited(rows).collect()}
    assert [got[i][0] for i in range(7)] == [True, True, False, False, True, False, True]
    assert got[2][1] == 40.0 and got[5][1] == 1.0


def test_limiter_stream_equals_batch(spark, data, tmp_path):
    from lectern.streaming.limiter import limited_stream

    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id").cast("string").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = limited_stream(stream, 2, 86400.0).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = limits.limited(events.select("*", F.lit(2).alias("times"), F.lit(86400.0).alias("seconds")))
    assert sorted(map(tuple, spark.table("told").select("event_id", "admitted").collect())) == sorted(map(tuple, batch.select("event_id", "admitted").collect()))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, ["pleural"], ["guide"], "a", True, 5, None), (2, ["none"], ["none"], "a", True, 7, "boom")], "query_id int, keywords array<string>, sources array<string>, category string, should_answer boolean, latency_ms int, error string")
    results = spark.createDataFrame([(1, 1, "x", "Other", "d1", 0.9), (1, 2, "PLEURAL line", "Guide", None, 0.8)], "query_id int, rank int, text string, title string, document_id string, score double")
    rows = evaluate.ranks(questions, results)
    got = {r["query_id"]: r for r in rows.collect()}
    assert (got[1]["keyword_rank"], got[1]["mrr"], got[1]["distinct_documents"], got[1]["top_score"]) == (2, 0.5, 2, 0.9)
    assert (got[2]["keyword_rank"], got[2]["mrr"], got[2]["n_results"]) == (None, 0.0, 0)
    s = evaluate.summary(rows).first()
    assert (s["keyword_recall_5"], s["mrr"], s["errors"], s["median_latency_ms"]) == (50.0, 0.25, 1, 6.0)


def test_pixels(spark):
    row = spark.createDataFrame([([0, 50, 100],)], "p array<int>")
    assert row.select(imaging.windowed(F.col("p")).alias("x")).first()["x"] == [0, 127, 255]
    assert row.select(imaging.windowed(F.array(F.lit(5), F.lit(5))).alias("x")).first()["x"] == [0, 0]
    assert row.select(imaging.shown(F.col("p"), F.lit("MONOCHROME1")).alias("x")).first()["x"] == [255, 205, 155]
    tags = F.create_map(F.lit("Modality"), F.lit("CT"), F.lit("PatientName"), F.lit("Doe"))
    assert row.select(imaging.allowed(tags).alias("x")).first()["x"] == {"modality": "CT"}
    assert row.select(imaging.study_year(F.lit("20190704")).alias("x")).first()["x"] == datetime.date(2019, 1, 1)
    assert row.select(imaging.study_year(F.lit("18990704")).alias("x")).first()["x"] is None


ARTICLE = """<article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type="pmc">PMC1</article-id>
<title-group><article-title>A title</article-title></title-group><pub-date><year>2020</year></pub-date>
<permissions><license xmlns:xlink="x" xlink:href="https://creativecommons.org/licenses/by-nc/4.0/"/></permissions></article-meta></front>
<body><p>The tide gauge failed twice <xref>12</xref>, once in spring and once after the flood. {more}</p>
<fig id="f1"><label>Fig 1</label><caption><p>A caption</p></caption><graphic xmlns:xlink="x" xlink:href="gr1"/></fig><fig><graphic xmlns:xlink="x" xlink:href="logo.png"/></fig></body></article>"""


def test_articles(spark):
    a = markup.article(ARTICLE.replace("{more}", "words " * 200))
    assert a["licence"] == "CC-BY-NC 4.0" and a["pmcid"] == "PMC1"
    assert "twice , once in spring" in a["content"] and "12" not in a["content"] and "caption" not in a["content"]
    assert [f["href"] for f in a["figures"]] == ["gr1", "logo.png"]
    assert markup.article(ARTICLE.replace("{more}", "")) is None
    assert markup.article(ARTICLE.replace("{more}", "w " * 400).replace("creativecommons.org", "closed")) is None
    assert markup.article("no markup") is None
    rows = spark.createDataFrame([(1, ARTICLE.replace("{more}", "words " * 200)), (2, None)], "id int, xml string")
    parsed = markup.articles(rows)
    assert {r["id"]: r["article"] is None for r in parsed.collect()} == {1: False, 2: True}
    assert [tuple(r) for r in markup.figure_rows(parsed, "id").select("id", "pos", "figure.href").collect()] == [(1, 0, "gr1")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grün".encode())
    (tmp_path / "b.TXT").write_bytes("grün".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    got = {r["filename"]: (r["text"], r["error"] is None) for r in files.load(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("grün", True), "b.TXT": ("grün", True), "c.exe": (None, False)}
    assert files.extensions_of('["PDF", ".txt"]') == [".pdf", ".txt"] == files.extensions_of("pdf, TXT")


def test_docx(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cells = lambda *texts: "<w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in texts) + "</w:tr>"
    body = p("First ", "line") + p("") + f"<w:tbl>{cells('a', 'b')}{cells('c', '')}</w:tbl>" + p("last")
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "blank.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('')}</w:body></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"PK no")
    got = {r["filename"]: (r["text"], r["error"] is None) for r in files.load(spark, str(tmp_path)).collect()}
    assert got == {"r.docx": ("First line\n\nlast\n\na | b\n\nc", True), "blank.docx": (None, False), "broken.docx": (None, False)}


def test_dicom_marks_and_confidence(spark):
    kind = "content binary, name string"
    rows = spark.createDataFrame([(b"\0" * 128 + b"DICM" + b"x", "a"), (b"short", "b.DCM"), (b"short", "c.txt"), (None, "d.dicom")], kind)
    assert [r["x"] for r in rows.select(imaging.is_dicom(F.col("content"), F.col("name")).alias("x")).collect()] == [True, True, False, True]
    told = spark.createDataFrame([([90.0, -1.0, 80.5],), ([-1.0],)], "c array<double>").select(imaging.mean_confidence(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in told] == [85.3, 0.0]
    frames = spark.createDataFrame([([[1], [2], [3]],), ([[1], [2]],), ([],)], "f array<array<int>>").select(imaging.middle(F.col("f")).alias("x")).collect()
    assert [r["x"] for r in frames] == [[2], [2], None]


def test_stored_points(spark):
    from lectern.operators import vector
    from lectern.plans import ingest

    docs = spark.createDataFrame([(1, "Title", "f.txt", "kb", "word " * 300), (2, None, "f.txt", "kb", "too short")], "document_id int, title string, filename string, source_type string, text string")
    points = ingest.points(docs, vector.HashingEmbedder(16))
    first = {r["point_id"]: r for r in points.collect()}
    assert {r["document_id"] for r in first.values()} == {1} and len(first) > 2
    again = {r["point_id"]: r for r in ingest.reindex(points.withColumn("title", F.lit("Other")), vector.HashingEmbedder(16)).collect()}
    assert again.keys() == first.keys() and all(r["search_text"].startswith("Other. ") for r in again.values())
    blank = points.limit(1).withColumn("text", F.lit("")).withColumn("point_id", F.lit("blank"))
    seen = ingest.scan(points.withColumn("search_text", F.lit("")).unionByName(blank)).collect()
    assert {r["point_id"] for r in seen} == first.keys() and all(r["search_text"] == r["text"] for r in seen) and "embedding" not in seen[0]
    assert {r["chunk_index"] for r in metadata.chunks_of(points, 1, offset=1, limit=2).collect()} == {1, 2}
    with pytest.raises(ValueError):
        metadata.chunks_of(points, offset=-1)


def test_vectors_of_another_length_are_an_error(spark):
    stored = spark.createDataFrame([("a", [1.0, 2.0], "x")], "point_id string, embedding array<double>, text string")
    new = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 1.0])], "point_id string, embedding array<double>")
    assert [tuple(r) for r in metadata.update_vectors(stored, new).collect()] == [("a", [3.0, 4.0], "x")]
    with pytest.raises(Exception, match="another length"):
        metadata.update_vectors(stored, spark.createDataFrame([("a", [3.0])], new.schema)).collect()


def test_uploads(spark):
    rows = spark.createDataFrame([("a.pdf", 5), ("b.exe", 5), ("c", 5), (None, 5), ("d.PDF", 0), ("e.txt", 11)], "filename string, size int")
    assert [r["status"] for r in metadata.accepted(rows, [".pdf", ".txt"], 10).collect()] == ["pending"] + ["rejected"] * 5


def test_events_of_a_stream_are_taken_once(spark, data, tmp_path):
    from lectern.streaming import windows

    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")], "event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert windows.deduplicated(events).count() == 2
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [1, 2]


def test_chunks_as_a_table_function(spark):
    from lectern.operators import chunking

    chunking.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunk_text(repeat('a', 12), 5, 0)").collect()] == [(0, "aaaaa"), (1, "aaaaa"), (2, "aa")]


def test_buckets_of_limits(spark):
    rows = spark.createDataFrame([(f"{b}:me", i, float(i), *limits.BUCKETS[b]) for b in limits.BUCKETS for i in range(25)], "key string, event_id int, ts double, times int, seconds int")
    got = {r["key"].split(":")[0]: r["n"] for r in limits.limited(rows).groupBy("key").agg(F.count_if("admitted").alias("n")).collect()}
    assert got == {b: times for b, (times, _) in limits.BUCKETS.items()}


def test_top_up_goes_on_where_it_stopped(spark, tmp_path):
    from lectern.operators import vector
    from lectern.streaming import topup

    docs = lambda rows: spark.createDataFrame(rows, "document_id long, title string, filename string, source_type string, text string")
    long, folder, store = "enough words to be taken " * 4, str(tmp_path / "in"), str(tmp_path / "store")
    first = docs([(1, "a", None, "kb", long), (2, "a", None, "kb", long), (3, "b", None, "kb", "short"), (4, None, None, None, long)])
    first.coalesce(1).write.parquet(folder)
    run = lambda: {r["reason"]: r["n"] for r in topup.top_up(spark, folder, store, first.schema, vector.HashingEmbedder(8), files=1).collect()}
    assert run() == {"completed": 2, "failed": 1, "skipped": 1}
    assert run() == {"completed": 2, "failed": 1, "skipped": 1}
    docs([(5, "a", None, "kb", long), (6, "c", None, "kb", long), (7, None, None, None, long), (8, "b", None, "kb", long)]).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {"completed": 4, "failed": 1, "skipped": 3}
    assert {r["document_id"] for r in spark.read.parquet(store + "/points").select("document_id").collect()} == {1, 4, 6, 8}


def test_plain_texts_and_merged_metadata(spark):
    from lectern.functions import text
    from lectern.plans import ingest

    rows = spark.createDataFrame([("T", None), ("U", "u.txt")], "title string, filename string")
    assert [r["filename"] for r in ingest.texts(rows).collect()] == ["T", "u.txt"]
    assert [r["filename"] for r in ingest.texts(rows.drop("filename")).collect()] == ["T", "U"]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "y"})], "p map<string,string>, q map<string,string>")
    assert [r["m"] for r in maps.select(text.merged(F.col("p"), F.col("q")).alias("m")).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "y"}]


def test_an_index_is_stale_when_chunks_come(spark):
    from lectern.operators import lexical

    chunks = spark.createDataFrame([(1, "pleural line"), (2, "the"), (3, None)], "id int, text string")
    index = lexical.build(chunks, "id")
    assert not lexical.stale(index, chunks)
    assert lexical.stale(index, chunks.unionByName(chunks.limit(1)))
