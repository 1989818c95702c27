"""Image files, citation files, pages of articles and the index that follows, by example and brute force."""

import io
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import imaging, lexical, metadata, segments, vector
from lectern.plans import search
from lectern.sources import dicom, pubmed
from lectern.streaming import connector, topup

SYNTAXES = [dicom.IMPLICIT, dicom.EXPLICIT, dicom.BIG, dicom.DEFLATED]
TAGS = {"Modality": "MR", "StudyDate": "19991231", "PhotometricInterpretation": "MONOCHROME2", "WindowCenter": "50\\7", "WindowWidth": "80\\9"}


def shown(pixels, slope=1.0, intercept=0.0, low=None, high=None):
    real = [p * slope + intercept for p in pixels]
    low, high = (min(real), max(real)) if low is None else (low, high)
    high = high if high > low else low + 1
    return bytes(int(max(0.0, min(1.0, (x - low) / (high - low))) * 255) for x in real)


@pytest.mark.parametrize("syntax", SYNTAXES)
@pytest.mark.parametrize("kind", ["u1", "i1", "u2", "i2", "i4"])
def test_pixels_of_every_kind(syntax, kind):
    rng = np.random.default_rng(1)
    info = np.iinfo(kind)
    frames = rng.integers(max(info.min, -1000), min(info.max, 1000), (4, 3, 5), endpoint=True).astype(kind)
    got = dicom.image(dicom.encode(frames, TAGS, syntax))
    assert (got["rows"], got["columns"], got["frames"]) == (3, 5, 4)
    # of four frames the third
    assert got["levels"] == shown(frames[2].ravel().tolist(), low=10.0, high=90.0)
    assert got["tags"]["Modality"] == "MR" and got["tags"]["Rows"] == "3" and got["study_date"] == "19991231"
    plain = dicom.image(dicom.encode(frames[:1], {"PhotometricInterpretation": "MONOCHROME1", "RescaleSlope": "0", "RescaleIntercept": "-3.5", "WindowWidth": "0"}, syntax))
    assert plain["levels"] == bytes(255 - x for x in shown(frames[0].ravel().tolist(), 1.0, -3.5))
    flat = dicom.image(dicom.encode(np.full((1, 2, 2), 7, kind), {}, syntax))
    assert flat["levels"] == bytes(4)


def test_levels_are_those_of_the_columns(spark):
    rng = np.random.default_rng(2)
    cases = [(rng.integers(-500, 500, 12).tolist(), s, i, c, w, p) for s in (None, 0.0, 2.0) for i in (None, -7.5) for c, w in ((None, None), (40.0, 0.0), (40.0, 300.0)) for p in ("MONOCHROME1", "MONOCHROME2")]
    frame = spark.createDataFrame(cases, "pixels array<int>, s double, i double, c double, w double, p string")
    column = imaging.shown(imaging.windowed(F.col("pixels"), F.col("s"), F.col("i"), F.col("c"), F.col("w")), F.col("p"))
    assert [r["v"] for r in frame.select(column.alias("v")).collect()] == [dicom.levels(np.array(x[0]), *x[1:]).tolist() for x in cases]


def nested(order, explicit):
    """A sequence of undefined length with items of defined and undefined length, which hold pixels and sequences of their own."""
    tag = lambda *t: struct.pack(order + "HH", *t)
    long = lambda t, kind, n, value: tag(*t) + (kind + b"\0\0" if explicit else b"") + struct.pack(order + "I", n) + value
    item = lambda n, value: tag(0xFFFE, 0xE000) + struct.pack(order + "I", n) + value
    end = lambda e: tag(0xFFFE, e) + bytes(4)
    pixels = long(dicom.ELEMENTS["PixelData"], b"OW", 4, b"\1\2\3\4")
    deep = long((0x0008, 0x1140), b"SQ", dicom.UNDEFINED, item(dicom.UNDEFINED, pixels + end(0xE00D)) + item(len(pixels), pixels) + end(0xE0DD))
    return long((0x0008, 0x1115), b"SQ", dicom.UNDEFINED, item(dicom.UNDEFINED, deep + end(0xE00D)) + end(0xE0DD)) + long((0x0008, 0x1199), b"SQ", len(item(len(deep), deep)), item(len(deep), deep))


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_what_sequences_hold_is_passed_over(syntax):
    frames = np.arange(6, dtype="u2").reshape(1, 2, 3)
    before = [nested(">" if syntax == dicom.BIG else "<", syntax != dicom.IMPLICIT)]
    assert dicom.image(dicom.encode(frames, {}, syntax, before))["levels"] == shown(range(6))


def test_unknown_representation_of_undefined_length():
    """Inside an explicit data set it is written implicitly."""
    value = b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + b"\x08\x00\x60\x00\x02\x00\x00\x00XX" + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    before = [b"\x08\x00\x11\x11UN\0\0\xff\xff\xff\xff" + value]
    assert dicom.image(dicom.encode(np.zeros((1, 2, 2), "u1"), {"Modality": "CT"}, dicom.EXPLICIT, before))["tags"]["Modality"] == "CT"


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_a_file_that_is_cut_off_is_an_error_at_every_place(syntax):
    order = ">" if syntax == dicom.BIG else "<"
    whole = dicom.encode(np.arange(12, dtype="i2").reshape(1, 3, 4), TAGS, syntax, [nested(order, syntax != dicom.IMPLICIT)])
    for n in range(len(whole)):
        with pytest.raises((dicom.Malformed, struct.error)):
            dicom.image(whole[:n])


def test_files_that_hold_no_image():
    frames = np.zeros((1, 2, 2), "u1")
    compressed = dicom.encode(frames, {}).replace(b"1.2.840.10008.1.2.1\0", b"1.2.840.10008.1.2.5\0")
    for content in (b"", bytes(200), b"no image at all", compressed, dicom.encode(frames, {"SamplesPerPixel": 3}), dicom.encode(frames, {"Rows": 200}), dicom.encode(frames, {"NumberOfFrames": "3"}), dicom.encode(frames, {"WindowCenter": "x", "WindowWidth": "1"})):
        with pytest.raises((dicom.Malformed, struct.error)):
            dicom.image(content)
    # without preamble and mark
    bare = dicom.encode(frames, {}, dicom.IMPLICIT)
    meta = 132 + 12 + struct.unpack_from("<I", bare, 132 + 8)[0]
    assert dicom.image(bare[meta:])["rows"] == 2


def test_a_folder_of_images(spark, tmp_path):
    frames = np.arange(4, dtype="u1").reshape(1, 2, 2)
    for name, content in (("a.dcm", dicom.encode(frames, TAGS)), ("b", dicom.encode(frames, {})), ("c.dicom", b"broken"), ("d.txt", b"no image")):
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(r["path"]): r for r in dicom.load(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.dcm", "b", "c.dicom"} and got["c.dicom"]["error"] and got["c.dicom"]["levels"] is None
    assert got["a.dcm"]["metadata"]["modality"] == "MR" and got["a.dcm"]["study_year"].year == 1999 and bytes(got["b"]["levels"]) == shown(range(4))


# ---- citations ----


def citation(i, closed=True, text="x" * 120):
    return f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i} &amp; <i>more</i></ArticleTitle><Abstract><AbstractText>{text}</AbstractText><AbstractText Label='END'>last</AbstractText></Abstract><AuthorList><Author><LastName>Ü</LastName><Initials>A</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation>{'</PubmedArticle>' if closed else ''}\n"


def test_any_ranges_give_the_same_records():
    rng = random.Random(3)
    parts = ["<?xml version='1.0'?><PubmedArticleSet>"] + [citation(i, i % 9 != 4, "äö" * rng.randrange(0, 300)) for i in range(60)] + ["</PubmedArticleSet>", citation(99, False)]
    data = "".join(parts).encode()
    whole = list(pubmed.chunks(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 61 and [c for *_, c in whole] == [i % 9 != 4 for i in range(60)] + [False]
    assert all(data[at : at + len(m)] == m for at, m, _ in whole)
    for split in (7, 100, 1000, 5000):
        for block in (16, 333, 1 << 20):
            if split * block > 1000:
                found = [x for b in range(0, len(data), split) for x in pubmed.chunks(io.BytesIO(data), b, b + split, block)]
                assert found == whole


def test_records():
    assert pubmed.record(citation(5).encode()) == ("5", "T5 & more", "x" * 120 + " END: last", ["Ü A", "Group"], None)
    assert pubmed.record(b"<PubmedArticle><a></PubmedArticle>")[-1] and pubmed.record(citation(5).encode(), False)[-1]
    assert pubmed.record(b"<PubmedArticle></PubmedArticle>") == ("", "Untitled", "", [], None) or pubmed.record(b"<PubmedArticle></PubmedArticle>")[1] == "Untitled"


def test_citations_as_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>" + "".join(citation(i) for i in range(30)) + "</PubmedArticleSet>")
    (tmp_path / "b.xml").write_text("".join(citation(i) for i in range(25, 40)) + citation(50, text="short") + citation(51, False))
    (tmp_path / "_SUCCESS").write_text("")
    expected = sorted({f"{i}" for i in range(40)} - {"3"})
    stored = spark.createDataFrame([("T3 & more", "statpearls"), ("T4 & more", "other")], "title string, source_type string")
    for split in (200, 1 << 20):
        records = pubmed.load(spark, str(tmp_path), split)
        assert records.count() == 47 and records.filter("error IS NOT NULL").count() == 1
        made = pubmed.documents(records, stored)
        assert sorted(r["pmid"] for r in made.collect()) == expected
    row = made.filter("pmid = '7'").first()
    assert row["text"].startswith("\nT7 & more\n\nAuthors: Ü A, Group\nSource: StatPearls / PubMed (PMID: 7)\n") and row["filename"] == "statpearls_7.txt"


# ---- pages ----


def page(*titles, licence="open-access"):
    body = "some words of the body " * 40
    return "<set>" + "".join(f"<article><front><article-meta><article-id pub-id-type='pmc'>{t}</article-id><title-group><article-title>{t}</article-title></title-group><permissions><license license-type='{licence}'/></permissions></article-meta></front><body><p>{body}</p></body></article>" for t in titles) + "</set>"


def test_pages_are_taken_once_whatever_is_cut_off(spark, tmp_path):
    folder, store = tmp_path / "pages", str(tmp_path / "store")
    for topic, name, content in (("a", "p1", page("A1", "A2")), ("a", "p2", "<set><article>"), ("b", "p1", page("B1", "A1")), ("c", "p1", page("C1", licence="closed"))):
        (folder / topic).mkdir(parents=True, exist_ok=True)
        (folder / topic / name).write_text(content)
    fetch = lambda: {(r["topic"], r["reason"]): r["n"] for r in connector.fetch(spark, str(folder), store, vector.HashingEmbedder(8)).collect()}
    first = fetch()
    taken = {k: n for k, n in first.items() if k[1] in ("completed", "skipped")}
    assert first[("a", "unreadable")] == 1 and first[("c", "no access")] == 1 and sum(taken.values()) == 4 and sum(n for (_, r), n in taken.items() if r == "completed") == 3
    assert fetch() == first
    # a batch that was begun but isn't in the log is run again, with the same pages and no others
    commits = tmp_path / "store" / "log" / "commits"
    for f in commits.iterdir():
        f.unlink()
    (folder / "a" / "p3").write_text(page("A3", "A2"))
    (folder / "d").mkdir()
    (folder / "d" / "p1").write_text(page("D1"))
    # the run that makes up for the batch may end with it; the next one takes what is new
    fetch()
    again = fetch()
    assert again[("d", "completed")] == 1 and sum(again.values()) == sum(first.values()) + 3
    titles = [r["title"] for r in spark.read.parquet(store + "/points").select("title").distinct().collect()]
    assert sorted(titles) == ["A1", "A2", "A3", "B1", "D1"]
    points = spark.read.parquet(store + "/points")
    assert points.count() == points.select("point_id").distinct().count()


def test_bundles_of_pages_are_taken_like_single_ones(spark, tmp_path):
    """A file for each page costs more than what is in it: hundreds of pages lie in a few files, and each still counts for itself."""
    bundled, single, kept = str(tmp_path / "bundled"), tmp_path / "single", connector.BUNDLE_PAGES
    pages = [("a", page(f"A{i}", f"A{i // 2}") if i % 7 else "<set><article>") for i in range(kept + 9)] + [("b", page("A1", "B", licence="closed")), ("b", None), ("b", page("B"))]
    frame = spark.createDataFrame(pages, "topic string, value string").coalesce(1)
    connector.store(frame, bundled)
    files = list((tmp_path / "bundled").rglob("*.parquet"))
    assert len(files) == 3
    for i, (topic, value) in enumerate(pages):
        (single / f"topic={topic}").mkdir(parents=True, exist_ok=True)
        (single / f"topic={topic}" / f"p{i:04}").write_text(value or "")
    fetch = lambda folder, store: {(r["topic"], r["reason"]): r["n"] for r in connector.fetch(spark, folder, str(tmp_path / store), vector.HashingEmbedder(8)).collect()}
    first = fetch(bundled, "one")
    assert first == fetch(str(single), "two") and first[("topic=a", "unreadable")] == 38 and first[("topic=b", "unreadable")] == 1
    assert fetch(bundled, "one") == first
    points = spark.read.parquet(str(tmp_path / "one" / "points"))
    assert points.count() == points.select("point_id").distinct().count()
    # a bundle that can't be read is one unreadable page
    (tmp_path / "bundled" / "topic=c").mkdir()
    (tmp_path / "bundled" / "topic=c" / "x.parquet").write_text("no bundle")
    assert fetch(bundled, "one") == first | {("topic=c", "unreadable"): 1}


def test_top_up_takes_the_row_that_holds_a_text(spark, tmp_path):
    """Of rows of one title the first may hold too little: what ingestion accepts is stored."""
    kind = "document_id long, title string, filename string, source_type string, text string"
    long, folder, store = "enough words to be taken " * 4, str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(1, "T", None, "kb", "short"), (2, "T", None, "kb", long), (2, "T", None, "kb", long), (None, "U", None, "kb", long), (3, "V", None, "kb", None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(folder)
    run = lambda: {r["reason"]: r["n"] for r in topup.top_up(spark, folder, store, spark.createDataFrame([], kind).schema, vector.HashingEmbedder(8)).collect()}
    assert run() == {"completed": 1, "failed": 3, "skipped": 1}
    assert [r["document_id"] for r in spark.read.parquet(store + "/points").select("document_id").collect()] == [2]


@pytest.mark.parametrize("seed", range(3))
def test_told_by_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "short", "enough words to be taken " * 4])
    rows = [(rng.choice([None, rng.randrange(20)]), rng.choice(["a", "b", "c", None]), "kb", text(), rng.choice([None, None, "unreadable"])) for _ in range(60)]
    known = {("a", "kb")}
    batch = spark.createDataFrame(rows, "document_id long, title string, source_type string, text string, reason string")
    got = sorted(str((r["document_id"], r["title"], r["reason"])) for r in topup.told(batch, spark.createDataFrame(list(known), "title string, source_type string")).collect())
    able = {}
    for i, (d, t, s, x, r) in enumerate(rows):
        if r is None and d is not None and len(x or "") >= 50:
            able[t] = min(able.get(t, (d, i)), (d, i))
    expected = []
    for i, (d, t, s, x, r) in enumerate(rows):
        enough = d is not None and len(x or "") >= 50
        expected.append((d, t, r or ("skipped" if (t, s) in known else "completed" if able.get(t, (None, None))[1] == i else "skipped" if enough else "failed")))
    count = lambda out: {k: sum(x[1:] == k for x in out) for k in {x[1:] for x in out}}
    assert count([eval(x) for x in got]) == count(expected)


# ---- the index that follows ----


def state_of(index):
    postings = sorted(map(tuple, index.postings.select("term", "id", "tf", "dl", "lead").collect()))
    return postings, sorted(map(tuple, index.frequencies.collect())), [(r["n"], round(r["avgdl"] or 0, 9)) for r in index.size.collect()]


@pytest.mark.parametrize("seed", range(2))
def test_any_changes_leave_the_index_of_a_full_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = ["pleural", "line", "the", "knee", "ct", "mr", "übel"]
    store, held = segments.Store(spark, str(tmp_path / "index"), most=3), {}
    kind = "document_id long, id string, text string"
    for number in range(6):
        rows = []
        for d in rng.sample(range(12), 4):
            chunks = [(d, f"{d}/{i}", " ".join(rng.choices(words, k=rng.randrange(6))) or None) for i in range(rng.randrange(3))]
            rows += chunks or [(d, None, None)]
            held[d] = chunks
        rows += [(None, "x", "no document")]
        batch = spark.createDataFrame(rows, kind)
        store.apply(batch, number)
        if number == 3:
            store.apply(batch.limit(1), number)  # applied before: nothing changes
            store.vacuum()
        full = lexical.build(spark.createDataFrame([c for own in held.values() for c in own], kind), "id")
        assert state_of(store.index()) == state_of(full)
    assert len(store.segments()) <= 4
    queries = spark.createDataFrame([(0, "pleural line knee")], "item_id int, text string")
    assert lexical.search(store.index(), queries).collect() == lexical.search(full, queries).collect()
    # a segment that a cut-off change left behind counts for nothing and is written anew
    last = max(store.versions())
    store._write("postings", last // 2 * 2 + 2, spark.createDataFrame([("junk", "z", 1, 1, 1, True)], "term string, id string, document_id long, tf long, dl int, lead boolean"))
    assert state_of(store.index()) == state_of(full)
    store.apply(spark.createDataFrame([(50, "50/0", "new words")], kind), 6)
    assert {r["term"] for r in store.index().postings.select("term").collect()} & {"junk", "new"} == {"new"}


def test_an_empty_index_and_one_that_follows_a_stream(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "index"))
    assert store.index().postings.count() == 0 and store.index().size.first()["n"] == 0
    kind = "document_id long, id string, text string"
    incoming = str(tmp_path / "in")
    spark.createDataFrame([(1, "1/0", "pleural line"), (2, "2/0", "knee")], kind).coalesce(1).write.parquet(incoming)
    follow = lambda: store.follow(spark.readStream.schema(kind).parquet(incoming), str(tmp_path / "log"))
    follow()
    spark.createDataFrame([(1, None, None), (2, "2/0", "knee joint")], kind).coalesce(1).write.mode("append").parquet(incoming)
    follow()
    follow()
    assert sorted(r["term"] for r in store.index().postings.collect()) == ["joint", "knee"] and len(store.versions()) == 2


def test_changes_shuffle_no_posting(spark, tmp_path, monkeypatch):
    """Postings are many times the texts when they are dealt out: they are written, found and merged where they lie."""
    plans, write = [], segments.Store._write

    def record(self, table, segment, rows):
        if table in ("postings", "sizes"):
            plans.append(rows._jdf.queryExecution().toString())
        write(self, table, segment, rows)

    monkeypatch.setattr(segments.Store, "_write", record)
    monkeypatch.setattr(segments, "BROADCAST", 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    for kept, few in ((spark.range(8), True), (spark.range(40), False)):
        del plans[:]
        store = segments.Store(spark, str(tmp_path / f"index{few}"), most=2)
        rows = kept.selectExpr("id AS document_id", "concat(id, '/0') AS id", "concat('pleural line x', id % 7) AS text")
        for number in range(3):
            store.apply(rows.filter(F.col("document_id") % 3 >= number), number)
        assert len(store.segments()) == 1 and len(plans) == 8
        assert not any("RepartitionByExpression" in p for p in plans)
        assert any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans) != few
        assert state_of(store.index()) == state_of(lexical.build(rows, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_postings_of_chunks_are_those_of_a_build(spark):
    rows = [(f"c{i}", " ".join(random.Random(i).choices(["Pleural", "line", "the", "x1", "\u00fcbel", "-"], k=i % 9)) or None) for i in range(60)]
    frame = spark.createDataFrame([*rows, ("none", None)], "id string, text string")
    columns = ["term", "id", "tf", "dl", "lead"]
    assert sorted(map(tuple, lexical.postings(frame, "id").select(columns).collect())) == sorted(map(tuple, lexical.build(frame, "id").postings.select(columns).collect()))


def test_a_search_shuffles_no_pair_of_question_and_chunk(spark):
    frame = spark.createDataFrame([(f"c{i}", f"pleural line x{i % 5}") for i in range(200)], "id string, text string")
    queries = spark.createDataFrame([(i, f"pleural x{i % 7}") for i in range(30)], "item_id int, text string")
    found = lexical.search(lexical.build(frame, "id"), queries, top=3)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan  # the tasks score and tell the best of each question
    assert found.count() == 90 and found.filter("query_id = 0").orderBy("rank").first()["id"] == "c95"
    assert lexical.search(lexical.build(frame, "id"), queries.filter("item_id < 0")).collect() == []


# ---- nearest, slices, errors ----


def test_nearest_keep_ties_by_id_over_batches():
    rng = np.random.default_rng(4)
    for _ in range(20):
        best, n = search._Best(3, 5), 60
        scores, ids = np.round(rng.normal(size=(3, n)), 1), np.array([f"p{i:02}" for i in rng.permutation(n)], object)
        for start in range(0, n, 7):
            row, at = np.nonzero(scores[:, start : start + 7] >= best.least[:, None] - 1e-4)
            best.add(row, scores[row, at + start], ids[at + start])
        for q in range(3):
            expected = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if s >= 0)[:5]
            got = sorted((-s, i) for r, s, i in zip(best.row, best.score, best.id, strict=True) if r == q and s >= 0)
            assert got == expected


def test_nearest_round_halves_as_the_columns_do():
    """0.28125 lies between two scores of four digits: it ties with 0.2813, not with 0.2812."""
    best = search._Best(1, 2)
    best.add(np.zeros(3, np.int64), np.array([0.28125, 0.2813, 0.2812]), np.array(["b", "c", "a"], object))
    assert best.id.tolist() == ["b", "c"] and best.score.tolist() == [0.28125, 0.2813]


def test_chunks_past_a_thousand_can_be_read(spark):
    points = spark.range(1500).selectExpr("1 AS document_id", "CAST(id AS int) AS chunk_index")
    assert metadata.chunks_of(points, offset=1000, limit=600).count() == 500
