"""Figures, sizes of images, folders and stored runs."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import layout, resample
from lectern.sources import evaluations, figures

ARCHIVE = "https://host/articles"
PNG = b"\x89PNG\r\n\x1a\n...."


def xml(*hrefs):
    figs = "".join(f"<fig id='f{i}'><label>Fig {i}</label><caption>c{i}</caption><graphic href='{h}'/></fig>" for i, h in enumerate(hrefs))
    return f"<article xmlns:x='u'><body>{figs}</body></article>"


def run(spark, rows, files, store, **given):
    documents = spark.createDataFrame(rows, "document_id long, created_at date, source_url string, filename string, markup string, url string")
    told, counts = figures.top_up(documents, spark.createDataFrame(files, "url string, content binary"), store, ARCHIVE, F.make_date(F.lit(2026), F.lit(8), F.lit(11)), **given)
    return sorted([(r["document_id"], r["pos"], r["reason"]) for r in told.collect()], key=str), counts


def test_figures_are_taken_once_and_every_candidate_is_counted(spark, tmp_path):
    store, day = str(tmp_path), lambda n: datetime.date(2026, 1, n)
    link = lambda n: f"https://host/articles/PMC{n}/"
    rows = [
        (1, day(1), link(7), "a", xml("g0", "logo.png", "g2", "g3"), "clash"),
        (2, day(2), link(7), "a", xml("g0"), None),  # newer, with an address of the first
        (3, day(3), None, "notes.txt", xml("g0"), None),
        (4, day(3), link(8), "a", "<article", None),
        (5, day(3), None, "PMC9.txt", xml(), None),
        (6, None, link(10), "a", xml(*[f"h{i}" for i in range(9)]), None),
        (None, None, None, None, None, None),
    ]
    at = lambda n, href: f"{ARCHIVE}/PMC{n}/bin/{href}"
    files = [(at(7, "g0"), PNG), (at(7, "g0"), PNG + b"more"), (at(7, "g2"), b"no image"), (at(7, "g3"), b""), (at(10, "h1"), b"\xff\xd8\xff1"), (at(10, "h8"), PNG), ("other", PNG), (None, PNG)]
    told, counts = run(spark, rows, files, store)
    expected = [(1, 0, "existing"), (1, 1, "decorative"), (1, 2, "failed"), (1, 3, "failed"), (2, 0, "stored"), (3, None, "no number"), (4, None, "unreadable"), (5, None, "no figures")]
    expected += [(6, i, "stored" if i == 1 else "failed") for i in range(8)] + [(None, None, "no number")]
    assert told == sorted(expected, key=str)
    assert counts["documents"] == 7 and counts["candidates"] == len(told) == sum(counts[x] for x in figures.DOCUMENT_REASONS + figures.FIGURE_REASONS)
    held = {r["source_url"]: r for r in figures.stored(spark, store).collect()}
    first = held[at(7, "g0")]
    assert set(held) == {at(7, "g0"), at(10, "h1")} and first["file_size"] == len(PNG + b"more") and first["caption"] == "Fig 0 c0" and not first["is_deidentified"]
    assert first["storage_path"] == f"2026/08/11/{first['image_id']}.png" and held[at(10, "h1")]["mime_type"] == "image/jpeg"
    again, counts = run(spark, rows, files, store)
    assert counts["stored"] == 0 and counts["existing"] == 3 and figures.stored(spark, store).count() == 2
    # a file that was missing is taken by the next run, for the newest documents alone
    told, counts = run(spark, rows, [*files, (at(10, "h2"), PNG)], store, limit=6)
    assert counts["documents"] == 6
    assert figures.stored(spark, store).count() == 2 + counts["stored"]


def test_no_documents_and_a_folder_of_files(spark, tmp_path):
    assert run(spark, [], [], str(tmp_path / "store")) == ([], {"documents": 0, "candidates": 0} | dict.fromkeys(figures.DOCUMENT_REASONS + figures.FIGURE_REASONS, 0))
    (tmp_path / "files" / "PMC7" / "bin").mkdir(parents=True)
    (tmp_path / "files" / "PMC7" / "bin" / "g0").write_bytes(PNG)
    got = figures.from_folder(spark, str(tmp_path / "files"), ARCHIVE).collect()
    assert [(r["url"], bytes(r["content"])) for r in got] == [(f"{ARCHIVE}/PMC7/bin/g0", PNG)]


def test_one_address_of_many_documents(spark, tmp_path):
    rows = [(i, datetime.date(2026, 1, 1), "https://host/articles/PMC7/", "a", xml("g0"), None) for i in range(300)]
    _, counts = run(spark, rows, [(f"{ARCHIVE}/PMC7/bin/g0", PNG)], str(tmp_path))
    assert counts["stored"] == 1 and counts["existing"] == 299
    assert figures.stored(spark, str(tmp_path)).first()["document_id"] == 0


# ---- sizes and contrast ----


def area(image, rows, columns):
    """The mean of each new place's area, pixel by pixel."""
    out = np.zeros((rows, columns))
    for i in range(rows):
        for j in range(columns):
            total = weight = 0.0
            for y in range(image.shape[0]):
                for x in range(image.shape[1]):
                    h = min((i + 1) * image.shape[0] / rows, y + 1) - max(i * image.shape[0] / rows, y)
                    w = min((j + 1) * image.shape[1] / columns, x + 1) - max(j * image.shape[1] / columns, x)
                    if h > 0 and w > 0:
                        total, weight = total + h * w * float(image[y, x]), weight + h * w
            out[i, j] = total / weight
    return out


@pytest.mark.parametrize("shape,to", [((7, 5), (3, 2)), ((9, 4), (4, 4)), ((5, 11), (2, 4)), ((6, 6), (1, 1))])
def test_area_means_by_brute_force(shape, to):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.abs(resample.resized(image, *to) - area(image, *to)).max() <= 0.5 + 1e-6


def test_sizes_keep_the_aspect():
    assert resample.fitted(4000, 1000, 256) == (256, 64) and resample.fitted(10, 20, 256) == (10, 20) and resample.fitted(1, 9000, 256) == (1, 256)
    grown = resample.resized(np.array([[0, 100]], np.uint8), 1, 4)
    assert grown.tolist() == [[0, 25, 75, 100]]


def test_contrast_and_sharpness():
    image = np.array([[10] * 10 + [20] * 80 + [30] * 10], np.uint8)
    assert sorted(set(resample.contrasted(image, 1)[0].tolist())) == [0, 127, 255]
    assert set(resample.contrasted(image, 10)[0].tolist()) == {10, 20, 30}  # one level is left
    flat = np.full((4, 4), 9, np.uint8)
    assert (resample.contrasted(flat) == flat).all() and (resample.sharpened(flat) == flat).all()
    dot = np.full((3, 3), 50, np.uint8)
    dot[1, 1] = 60
    assert resample.sharpened(dot)[1, 1] == 70 and resample.sharpened(dot)[0].tolist() == [50] * 3


def test_images_as_columns(spark):
    kind = "id int, levels array<double>, rows int, columns int"
    rows = [(1, [0.0, 300.0, 10.4, -3.0], 2, 2), (2, None, 2, 2), (3, [1.0], 2, 2), (4, [1.0, None], 1, 2), (5, [1.0, 2.0], None, 2), (6, [], 0, 0)]
    frame = spark.createDataFrame(rows, kind)
    got = {r["id"]: r["x"] for r in frame.select("id", resample.thumbnail(F.col("levels"), F.col("rows"), F.col("columns")).alias("x")).collect()}
    assert bytes(got[1]["levels"]) == bytes([0, 255, 10, 0]) and [got[i] for i in range(2, 7)] == [None] * 5
    ready = frame.filter("id = 1").select(resample.prepare(F.col("levels"), F.col("rows"), F.col("columns")).alias("x")).first()["x"]
    assert (ready["rows"], ready["columns"], ready["upscaled"]) == (8, 8, True)
    stored = spark.createDataFrame([(bytes(range(6)), 2, 3)], "b binary, r int, c int").select(resample.fit(F.col("b"), F.col("r"), F.col("c")).alias("x")).first()["x"]
    assert bytes(stored["levels"]) == bytes(range(6))


# ---- folders and paths ----


def test_paths_stay_inside(spark):
    given = {"a/b": "a/b", "./a//b/../c": "a/c", "../a": None, "a/../../a/b": None, "/etc": None, "C:\\x": None, "a\\..\\b": "b", "": "", None: None}
    frame = spark.createDataFrame([(k,) for k in given], "p string")
    assert {r["p"]: r["x"] for r in frame.select("p", layout.normal(F.col("p")).alias("x")).collect()} == given
    assert frame.filter("p = 'a/b'").select(layout.resolve("s3://root/", F.col("p")).alias("x")).first()["x"] == "s3://root/a/b"
    with pytest.raises(Exception, match="outside the root"):
        frame.filter("p = '../a'").select(layout.resolve("root", F.col("p"))).collect()


def test_folders_change_alone(spark, tmp_path):
    kind, day = "document_id long, text string, source_type string, day date", lambda n: datetime.date(2026, 1, n)
    kept = layout.Table(spark, str(tmp_path / "t"), kind)
    assert kept.rows().count() == 0 and kept.stats().count() == 0
    kept.upsert(spark.createDataFrame([(1, "a", "x y", day(1)), (1, "b", "x y", day(1)), (2, "c", "x y", day(2)), (3, "d", "z/%+", day(1)), (4, "e", None, day(1))], kind))
    still = sorted(p.name for p in (tmp_path / "t" / "source_type=x y" / "day=2026-01-02").glob("*.parquet"))
    new = spark.createDataFrame([(1, "new", "z/%+", day(3)), (9, "i", "x y", day(1))], kind)
    for _ in range(2):
        kept.upsert(new)
        assert sorted(r["text"] for r in kept.rows().collect()) == ["c", "d", "e", "i", "new"]
    assert sorted(p.name for p in (tmp_path / "t" / "source_type=x y" / "day=2026-01-02").glob("*.parquet")) == still
    kept.delete(spark.createDataFrame([(3,), (4,), (77,), (None,)], "document_id long"))
    assert sorted(r["text"] for r in kept.rows().collect()) == ["c", "i", "new"]
    stats = {(r["source_type"], r["day"]): r["files"] for r in kept.stats().collect()}
    assert set(stats) == {("x y", "2026-01-01"), ("x y", "2026-01-02"), ("z/%+", "2026-01-03")}
    plan = kept._in(spark.createDataFrame([("x y", day(1))], "source_type string, day date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [source_type" in plan
    with pytest.raises(Exception, match="without document_id"):
        kept.upsert(spark.createDataFrame([(None, "a", "x", day(1))], kind))


# ---- stored runs ----


def test_questions_from_files(spark, tmp_path):
    asked = [{"id": "a", "category": "c", "question": "What?", "expect_keywords": ["k"], "note": "ignored"}, {"id": "b", "question": "Why?", "should_answer": False}]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one.json").write_text(json.dumps({"questions": asked}, indent=2))
    (tmp_path / "q" / "two.json").write_text(json.dumps({"questions": []}))
    got = {r["query_id"]: r for r in evaluations.questions(spark, str(tmp_path / "q")).collect()}
    assert got["a"]["keywords"] == ["k"] and got["a"]["sources"] == [] and got["a"]["should_answer"] and not got["b"]["should_answer"] and got["b"]["category"] == ""
    for fault, message in (([asked[0], asked[0]], "more than one"), ([{"id": "x", "question": " "}], "no text"), ([{"question": "?"}], "without an id")):
        (tmp_path / "q" / "two.json").write_text(json.dumps({"questions": fault}))
        with pytest.raises(Exception, match=message):
            evaluations.questions(spark, str(tmp_path / "q")).collect()
    (tmp_path / "q" / "two.json").write_text("{cut")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|JSON"):
        evaluations.questions(spark, str(tmp_path / "q")).collect()


def test_runs_come_back_as_they_were(spark, tmp_path):
    kind = "query_id string, category string, should_answer boolean, latency_ms double, error string, keyword_rank int, source_rank int, mrr double, top_score double, distinct_documents long, n_results long, source_hit_5 boolean, source_hit_12 boolean, keyword_hit_5 boolean, keyword_hit_12 boolean"
    rows = [("a", "c", True, 0.1, None, 1, None, 1 / 3, 7.25, 2, 3, False, False, True, True), ("b\n\"", None, True, None, "timeout", None, None, 0.0, 0.0, 0, 0, False, False, False, False)]
    before = spark.createDataFrame(rows, kind)
    evaluations.save(before, str(tmp_path), "before")
    got = evaluations.results(spark, str(tmp_path), "before")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, before.select(*got.columns).collect()), key=str)
    evaluations.save(before.filter("query_id = 'a'"), str(tmp_path), "now")
    changed = {r["metric"]: r for r in evaluations.compared(spark, str(tmp_path), "before", "now").collect()}
    assert changed["n_questions"]["delta"] == -1 and changed["errors"]["before"] == 1 and changed["keyword_recall_5"]["better"]
    evaluations.save(before.filter("false"), str(tmp_path), "now")
    assert evaluations.summaries(spark, str(tmp_path)).filter("name = 'now'").select("summary.n_questions").first()[0] == 0
    with pytest.raises(ValueError, match="no run"):
        evaluations.compared(spark, str(tmp_path), "before", "other")
    with pytest.raises(ValueError, match="no name"):
        evaluations.save(before, str(tmp_path), "../x")
