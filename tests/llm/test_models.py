"""Toxicity, URL filter and nearest neighbours; the queries and the pipeline on the smallest tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import page_links
from lectern.llm import ann, toxicity, url_filter
from lectern.llm.common import read_table


def test_grades_are_learned_in_order():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    bad = ["vile", "nasty", "awful"]
    texts, grades = [], []
    for _ in range(900):
        g = int(rng.integers(4))
        texts.append(" ".join([*rng.choice(words, 40), *bad[:g]]))
        grades.append(g)
    each = [np.array([x for w in sorted(toxicity.words_of(t)) for x in toxicity.features(w)]) for t in texts]
    rows, buckets = np.repeat(np.arange(600), [len(x) for x in each[:600]]), np.concatenate(each[:600])
    model = toxicity.fit(rows, buckets, np.array(grades[:600]))
    assert (np.diff(model.thetas) > 0).all()
    f = model.scorer()
    severity = model.exceed(np.array([f(t) for t in texts[600:]])).sum(1)
    assert np.corrcoef(severity, grades[600:])[0, 1] > 0.9


def test_likelihood_by_brute_force():
    """The likelihood grade by grade, its gradients by differences."""
    import math

    rng = np.random.default_rng(5)
    grades, f, cut = rng.integers(0, 4, 40), rng.normal(size=40), np.array([-0.3, 0.2, -0.5])

    def loss(f, cut):
        over = lambda x, k: 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + math.exp(-(x - (cut[0] + sum(math.exp(c) for c in cut[1:k])))))
        return -sum(math.log(over(x, g) - over(x, g + 1)) for x, g in zip(f, grades, strict=True)) / len(f)

    got, by_f, by_cut = toxicity.likelihood(f, grades, cut)
    assert abs(got - loss(f, cut)) < 1e-12
    moved = lambda x, i, d: np.where(np.arange(len(x)) == i, x + d, x)
    for x, found, at in ((f, by_f, lambda y: loss(y, cut)), (cut, by_cut, lambda y: loss(f, y))):
        assert np.allclose(found, [(at(moved(x, i, 1e-6)) - at(moved(x, i, -1e-6))) / 2e-6 for i in range(len(x))], atol=1e-7)


def test_sample_is_bounded_by_its_features(spark, monkeypatch):
    rows = [(i, f"clean word{i} " * 3 + ("vile nasty" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows + [(i, "") for i in range(60)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    # the least text of an id teaches: all are empty
    assert len(toxicity.train(docs, labels).buckets) == 0
    docs = docs.filter("text <> ''")
    model = toxicity.train(docs, labels)
    assert len(model.buckets) and toxicity.score(docs, model).filter("toxic").count() == 30
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 3 * 3)
    assert len(toxicity.train(docs, labels).buckets) == 0


def test_driver_holds_the_sample_once(spark, monkeypatch):
    """Features come document by document into their place: what the driver holds is their array and that of their rows."""
    import tracemalloc

    got = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, buckets, grades: got.append((rows, buckets, grades)))
    n = 240
    texts = [" ".join(f"d{i}w{j}" for j in range(4000 + i)) for i in range(n)]
    docs = spark.createDataFrame([(n - 1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(n)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        toxicity.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows, buckets, grades = got[0]
    want = [[x for w in sorted(toxicity.words_of(t)) for x in toxicity.features(w)] for t in texts[::-1]]
    assert (buckets == np.concatenate(want)).all() and (rows == np.repeat(np.arange(n), [len(x) for x in want])).all() and grades.tolist() == [i % 3 for i in range(n)]
    assert peak < 2.75 * buckets.nbytes  # the two, and a batch of rows on its way


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    taught = labels.filter(F.abs(F.xxhash64("doc_id")) % 5 != 0)
    model = toxicity.train(docs, taught)
    tested = docs.join(labels.join(taught, "doc_id", "left_anti"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    found = toxicity.score(tested, model).join(tested.select("doc_id", "label"), "doc_id").select("toxic", "label").collect()
    hit = sum(r["toxic"] and r["label"] == 1 for r in found)
    assert hit / sum(r["label"] for r in found) > 0.9
    assert sum(r["toxic"] and r["label"] == 0 for r in found) <= 0.005 * len(found)


def test_awkward_toxicity(spark):
    docs = spark.createDataFrame([(1, "fine words", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, label string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("toxic").count() == 0
    assert sorted(map(str, toxicity.keep_clean(docs, none).collect())) == sorted(map(str, docs.collect()))
    assert toxicity.score(docs.limit(0), none).count() == 0
    all_null = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, all_null)).count() == 4


def page(url, canonical=None, refresh=None):
    html = "<html><head>"
    if canonical:
        html += f'<link href="{canonical}" rel="canonical">'
    if refresh:
        html += f"<META HTTP-EQUIV='Refresh' content='0; URL={refresh}'>"
    return url, html + "</head></html>"


def test_url_filter(spark):
    pages = [
        page("http://A.com/en/1"),
        page("http://example.com/en/7x"),
        page("https://x.net/de/8"),
        page("http://a.example.net/de/8#top"),
        page("http://alias.fr/1", canonical="http://b.com/en/2"),
        page("http://alias.fr/2", refresh="/1"),
        page("http://alias.fr/3", canonical="http://example.com/en/7"),
        page("http://net/de/1", canonical="http://c.com/en/3"),
        page("http://alias.fr/4?q#f", refresh="http://alias.fr/2"),
        page("http://notcom/en/1"),
        page("no scheme"),
        (None, None),
        ("http://alias.fr/1", None),
    ]
    rows = [(i, *p) for i, p in enumerate(pages)]
    redirects = [("http://old.fr/", "http://alias.fr/4?q")]
    edges = [("http://alias.fr/1", "http://b.com/en/2"), ("http://alias.fr/2", "http://alias.fr/1"), ("http://alias.fr/3", "http://example.com/en/7"), ("http://net/de/1", "http://c.com/en/3"), ("http://alias.fr/4?q#f", "http://alias.fr/2"), *redirects]
    df = spark.createDataFrame(rows + [(50, "http://old.fr/#x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(df, redirects=spark.createDataFrame(redirects, "from_url string, to_url string")).collect()}
    expected = page_links.brute_force([(r[0], r[1]) for r in rows] + [(50, "http://old.fr/#x")], url_filter.RULES, edges)
    assert {k: r["verdict"] for k, r in got.items()} == expected
    assert [expected[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 50)] == ["block", "allow", "allow", "block", "block", "block", "allow", "allow", "block", "allow", "block"]
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("a.example.net", "/de/8", "example.net/de/8")
    assert (got[10]["host"], got[10]["path"], got[10]["rule"]) == ("", "", None)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_targets_are_resolved(spark):
    """The cases of RFC 3986, and what pages write."""
    base = "http://a/b/c/d;p?q"
    targets = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/../x", "http://h/x/../y?z", "https://H", "/go?u=http://x/", "//h/../z", "é/ü"]
    rows = [(i, base, t) for i, t in enumerate(targets)]
    rows += [(100 + i, b, t) for i, (b, t) in enumerate([("http://a", "x"), ("http://a?q", "x"), ("http://a", "?x"), ("https://a/", "//b"), ("http://a/b", " c&amp;d ")])]
    from urllib.parse import urljoin, urlsplit

    def resolved(b, t):
        """urljoin leaves the dots of a target with a host."""
        to = urljoin(b, t.strip().replace("&amp;", "&"))
        return urljoin(to, urlsplit(to)._replace(scheme="", netloc="").geturl()) if "//" in t.split("?")[0] else to

    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, b string, t string").withColumn("t", url_filter.unescaped(F.col("t"))).select("i", url_filter.absolute(F.col("t"), F.col("b")).alias("x")).collect()}
    assert got == {i: resolved(b, t) for i, b, t in rows}
    for b, t in (("http://a/", "mailto:x@y"), ("http://a/", "javascript:x('http://b')"), ("http://a/", "#top"), ("http://a/", ""), ("a/b", "c"), (None, "c")):
        assert spark.createDataFrame([(b, t)], "b string, t string").select(url_filter.absolute(F.col("t"), F.col("b")).alias("x")).first()["x"] is None


@pytest.mark.parametrize("few", [url_filter.FEW, -1])
def test_references_bases_and_what_holds_no_links(spark, monkeypatch, few):
    """Links as browsers read them; with FEW below 0 all facts meet their rows in parts."""
    import duckdb

    from lectern.llm import queries

    monkeypatch.setattr(url_filter, "FEW", few)
    link = '<link rel="canonical" href="%s">'
    bodies = [
        "<link rel='canonical' href='http:&#x2F;&#x2F;b.com&#47;en/2'>",
        "<base href='http://b.com/en/'>" + link % "2",
        "<base target=_top><base href='//b.com/en/x'><base href='/other'>" + link % "2",
        "<base href='mailto:x@y'>" + link % "/en/2",
        "<!-- " + link % "http://b.com/en/2" + " -->",
        "<script>" + link % "http://b.com/en/2" + "</script >" + "<STYLE>" + link % "http://b.com/en/2" + "</style>",
        "<title>" + link % "http://b.com/en/2" + "</title>",
        "<!-- a --> " + link % "http://b.com/en/2" + "<!-- b -->",
        link % "http&colon;&sol;&sol;b&period;com/en/2&amp;&#233;&#x1F600;",
        link % "http://b.com/en/&#0;&#xD800;&#99999999;&unknown;&amp;amp;",
        "<meta http-equiv='refresh' content='0;url=&#39;http://b.com/en/2&#39;'>",
        "<link rel='&#99;anonical' href='http://b.com/en/2'>",
        "<p>&#1;</p>",
        None,
    ]
    rows = [(i, f"http://alias{i}.fr/x", b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame([*rows, (98, None, None), (99, "http://alias0.fr/x", "")], "page_id long, url string, html string")
    edges = page_links.markup_edges([r[1:] for r in rows])
    found = sorted(tuple(r) for r in url_filter.edges_of(df).collect())
    assert found == sorted(edges)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 98, 99)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "block", "block", "allow", "allow", "allow", "block"]
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    assert {r[0]: r[4] for r in con.execute(queries.OP5_SQL).fetchall()} == got


def test_all_links_of_a_page_count(spark):
    import duckdb

    from lectern.llm import queries

    rng = random.Random(13)
    hosts, paths = ["alias.fr", "b.com", "x.net", "example.com", "deep.alias.fr", "o.org"], ["/", "/en/1", "/en/7", "/de/1", "/x/y/z", "/x/y/", "", "/es/2?q=1", "/x?id=3"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths] + ["HTTP://ALIAS.FR/Up"]
    targets = [*urls, "../z", "z", "../../en/1", "?id=3", "?q=1", "//b.com/en/2", "//alias.fr", "/x/y/z", "./", "..", "#f", "mailto:a@b.com", "/x/./y/../y/", "/x?id=3&amp;n=1"]
    link = ["<link rel=\"canonical\" href='{t}'>", "<LINK href=\"{t}\" title='a > b' REL='alternate Canonical'/>", "<link rel=canonical href={t} >", "<link rel='canonicals' href='{t}'>", "<link data-rel='canonical' href='{t}'>"]
    meta = ["<meta http-equiv=refresh content=\"0;url='{t}'\">", "<META HTTP-EQUIV='Refresh' content='3; URL = {t}'>", "<meta content=\"0; {t}\" http-equiv=\"refresh\">", "<meta name=refresh content='0;url={t}'>"]
    rows = []
    for i, u in enumerate(urls * 2):
        html = "".join(rng.choice(link + meta).format(t=rng.choice(targets)) for _ in range(rng.randrange(4)) if rng.random() < 0.6)
        rows.append((i, u, f"<html><head>{html}</head><p>canonical http-equiv</p></html>"))
    rows += [(None, urls[0], None), (900, None, rows[0][2]), (901, "no scheme", rows[1][2]), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = page_links.markup_edges([r[1:] for r in rows])
    assert len(edges) > 40
    found = url_filter.edges_of(df).filter("from_url <> 'no scheme' AND from_url IS NOT NULL").collect()
    # schemes may differ in case
    assert sorted((a, b.split("://", 1)[1]) for a, b in found) == sorted((a, b.split("://", 1)[1]) for a, b in edges)
    expected = page_links.brute_force([(i, r[1]) for i, r in enumerate(rows)], url_filter.RULES, edges)
    got = sorted(map(str, url_filter.judge(df).collect()))
    judged = sorted((str(r["page_id"]), r["verdict"]) for r in url_filter.judge(df).collect())
    assert judged == sorted((str(r[0]), expected[i]) for i, r in enumerate(rows))
    assert 5 < sum(expected[i] == "block" for i in range(len(urls))) < len(urls)
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    rows_of = con.execute(queries.OP5_SQL)
    names = [c[0] for c in rows_of.description]
    assert names == ["page_id", "host", "path", "rule", "verdict"]
    # a join by url repeats a row of two pages that are one
    assert sorted({tuple(map(str, r)) for r in rows_of.fetchall()}) == sorted({tuple(map(str, r)) for r in url_filter.judge(df).collect()}) and got


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    same = rng.normal(size=16).astype(np.float32)
    vectors = [(i, (same if i % 3 == 0 else rng.normal(size=16)).astype(np.float32).astype(float).tolist()) for i in range(900)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [None] + [1.0] * 15), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (1100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    monkeypatch.setattr(ann, "BLOCK", 100)
    expected = brute(vectors)
    rows = ann.search(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    # a third of all vectors are one: ties go to the smaller ids
    assert [i for i, _ in got[0]] == [3 * i for i in range(1, 21)]
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected])
    assert recall >= 0.9
    exact = dict(vectors)
    for q, found in got.items():
        assert all(abs(s - np.dot(exact[q], exact[i])) < 1e-12 for i, s in found)


def other_vectors(kind, n, rng, d=16):
    x = rng.normal(size=(n, d))
    if kind == "queries unlike the rest":
        x = rng.normal(size=(100, d))[rng.integers(100, size=n)] + 0.1 * x
        x[::20] = 3 * rng.normal(size=(len(x[::20]), d))
    elif kind == "clusters of very many among wide ones":
        few = rng.normal(size=(3, d))[rng.integers(3, size=n)] + 1e-4 * x
        x = np.where(rng.random((n, 1)) < 0.5, few, x)
    elif kind == "lengths of any size":
        x *= rng.pareto(1.5, size=(n, 1)) + 0.1
    elif kind == "small clusters":
        x = 5 * rng.normal(size=(n // 25, d))[rng.integers(n // 25, size=n)] + 0.05 * x
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["queries unlike the rest", "clusters of very many among wide ones", "lengths of any size", "small clusters"])
def test_nearest_neighbours_of_other_rows(spark, monkeypatch, kind):
    """Every one of the nearest is found, whatever the rows are like; also with lists cut into blocks and few rows at a time."""
    for name, value in (("BLOCK", 300), ("ASKERS", 60), ("TABLES", 16), ("SCORES", 500), ("VECTORS", 1000)):
        monkeypatch.setattr(ann, name, value)
    rows = other_vectors(kind, 3000, np.random.default_rng(3))
    got = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute(rows)
    assert got.keys() == expected.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in found] for q, found in expected.items())
    assert all(s == t for q, found in expected.items() for (_, s), (_, t) in zip(got[q], found, strict=True))


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df).collect()] == [(0, 1, 1, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_queries(spark, data, name):
    import glob
    import os

    import duckdb

    from lectern.llm import queries

    full, fn = next((k, f) for k, f in queries.queries().items() if k.startswith(name + "_"))
    frame = fn(spark, data)
    rows = [tuple(map(str, r)) for r in frame.select(*sorted(frame.columns)).collect()]
    assert rows
    if full in queries.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        found = con.execute(queries.oracle_sql()[full])
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(frame.columns)
        assert sorted(rows) == sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def test_recall_on_the_tables(spark):
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    expected = brute([(r["vec_id"], r["embedding"]) for r in table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()])
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(got[q] & {i for i, _ in found}) / len(found) for q, found in expected.items()])
    assert recall >= 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n=60: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n // 12))
    clean = [text() for _ in range(60)]
    toxic = [text() + "\nyou vile nasty awful thing" for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean + toxic)]
    rows += [(100 + i, clean[i], "en", "s0", 1) for i in range(10)] + [(200, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = read_table(spark, d, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in after["toxicity"]} == {r[0] for r in rows} - set(range(60, 80))
    lines = {r["doc_id"]: r["text"] for r in after["line_dedup"]}
    assert lines[0] == clean[0] and all(lines[100 + i] == "" for i in range(10)) and lines[200] is None
    # what is left of the copies is empty, and one of these stays
    assert {r["doc_id"] for r in after["simhash"]} == set(range(60)) | {100}
    assert sum(p["length"] for p in after["packing"]) == sum(n for n in {p["doc_id"]: p["doc_tokens"] for p in after["packing"]}.values())
    # the order of a queue follows the input's partitions, what is packed doesn't
    totals = lambda rows: sorted({(r["doc_id"], r["doc_tokens"]) for r in rows})
    assert totals(corpus_pipeline.run(spark, d).collect()) == totals(after["packing"])


def test_labels_out_of_range_and_a_document_too_long_to_teach(spark, monkeypatch):
    """Negative labels teach nothing, high grades count as the highest, one long text doesn't empty the sample."""
    rng = random.Random(11)
    text = lambda bad: " ".join(rng.choices([f"w{i}" for i in range(60)], k=30) + (["vile", "nasty", "awful"] if bad else []))
    rows = [(i, text(i % 3 == 0)) for i in range(150)] + [(900 + i, " ".join(f"long{i}x{j}" for j in range(500))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    long = spark.createDataFrame([(900 + i, 0) for i in range(20)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "DOC_FEATURES", 1000)
    scores = lambda labels: sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, labels)).collect()))
    expected = scores(plain)
    assert sum(r[-1] for r in expected) >= 45
    assert scores(plain.unionByName(long)) == expected
    negative = spark.createDataFrame([(i, -1) for i in range(150, 170)] + [(900, -5), (None, 1)], "doc_id long, toxic int")
    assert scores(plain.unionByName(negative)) == expected
    grades = plain.withColumn("toxic", F.col("toxic") * 2)
    both = [scores(grades.union(negative).unionByName(spark.createDataFrame([(0, top)], "doc_id long, toxic int"))) for top in (3, 9)]
    assert both[0] == both[1] and max(r[3] for r in both[0]) <= 3
