"""MinHash near-duplicates, importance resampling and fill-in-the-middle by brute force, with the awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fill_in_middle, importance, minhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
NAMES = ["fp", "size", "bands", "counts", "row", "words", "bucket", "gain", "at", "part", "n", "form", "output", "prefix", "units", "own", "score", "rank", "key", "u", "v", "n_words", "__doc"]
AWKWARD = [
    (None, "no id here at all", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 0),
    (4, "single", "en", "s", 0),
    (5, "SINGLE ", "en", "s", 0),
    (6, "one two three four five six", "en", "s", 27),
    (7, "One  two\tthree four FIVE six", "en", "s", 28),
    (8, "one two three four five six", "en", "s", 27),
    (8, "one two three four five six", "en", "s", 27),
    (8, "Ünd so WEITER <S> mit\n\nallem", "en", "s", 27),
    (9, "no id here at all", "en", "s", 1),
    (-5, "x" * 60_000 + " " + "y\n" * 3000, "en", "t", 1),
]


def rows_of(frame):
    return sorted(str(tuple(r)) for r in frame.select(*sorted(frame.columns)).collect())


def clashing(docs):
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


# ---- MinHash ----


def set_of(text, words=2):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else []))


def near_by_brute_force(rows, words=2, percent=80):
    sets = [set_of(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids) if sets[i] and ids else r[0]
        out.append((r[0], len(sets[i]), low, r[0] == low))
    return out


def planted(rng, n=60, length=(5, 120)):
    """Texts, near copies of these, copies of copies, and texts that share a long passage."""
    vocabulary = [f"{rng.choice('abcdeü')}{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=rng.randrange(*length)) for _ in range(n)]
    passage = rng.choices(vocabulary, k=50)
    for _ in range(2 * n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(1, 2 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        base.append(words)
    base += [passage + rng.choices(vocabulary, k=rng.randrange(4, 40)) for _ in range(n)]
    return [" ".join(w) for w in base]


@pytest.mark.parametrize("length", [(2, 14), (5, 120)])
def test_near_duplicates_by_brute_force(spark, length):
    rng = random.Random(length[1])
    rows = AWKWARD + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(planted(rng, length=length))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    expected = sorted(map(str, near_by_brute_force(rows)))
    assert sorted(str(tuple(r)) for r in got.collect()) == expected
    assert sum("True" in x for x in expected) < len(rows) - 15


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOC).coalesce(1)
    for run in (minhash.near_duplicates, fill_in_middle.arrange, lambda d: importance.resample(d, docs.select("text"), least_words=2, share=50)):
        assert rows_of(run(clashing(docs))) == rows_of(run(docs))
        assert run(clashing(docs).limit(0)).count() == 0


def test_links_that_no_star_sees(spark, monkeypatch):
    """Two sets that meet under a centre that is unlike both: the rest of the bucket tells. A single bucket holds all."""
    monkeypatch.setattr(minhash, "band_keys", lambda sets: np.zeros((len(sets), minhash.BANDS), np.int64))
    rng = random.Random(9)
    texts = planted(rng, 15, (8, 30))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, near_by_brute_force(rows)))


def test_five_words(spark):
    rng = random.Random(3)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(planted(rng, 20, (30, 200)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC), words=5)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, near_by_brute_force(rows, 5)))


def test_bins_agree_as_sets_do():
    """The share of equal bins estimates the similarity, with few elements (mostly empty bins) as with many."""
    rng = np.random.default_rng(5)
    for n in (5, 40, 3000):
        shares = []
        for _ in range(60):
            x = rng.integers(-(2**63), 2**63 - 1, n)
            a, b = np.unique(x), np.unique(x[: -max(1, n // 5)])
            one, two = minhash.bins_of([a, b], 336)
            shares.append((one == two).mean())
            assert np.isin(one, a.view(np.uint64) ^ np.uint64(1 << 63)).all()
        assert abs(np.mean(shares) - 0.8) < 0.03


def test_small_sets_meet():
    """4 of 5 elements in common: none of many pairs is lost."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, 5)) for _ in range(3000)]
    whole, less = minhash.band_keys(sets), minhash.band_keys([x[:4] for x in sets])
    assert (whole == less).any(axis=1).all()


# ---- importance resampling ----


def resampled(rows, targets, share, least):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def buckets(text):
        own = words(text)
        return [zlib.crc32(" ".join(own[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(own) - k + 1)]

    s, t = np.zeros(10000), np.zeros(10000)
    for counts, texts in ((s, [r[1] for r in rows]), (t, targets)):
        for text in texts:
            for b in buckets(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text, *_ in rows:
        own = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: len(fit) * share // 100]):
        r[4] = i + 1
    return sorted(str(tuple(r[:5])) for r in out)


def test_resampling_by_brute_force(spark):
    rng = random.Random(4)
    rows = AWKWARD + [(100 + i, t, "en", "s", 1) for i, t in enumerate(planted(rng, 40))]
    rows += [(500, "equal rows of one document", "en", "s", 1)] * 30
    targets = [rows[30][1], rows[40][1].upper(), None, "ÄÖ äö 12-34", ""]
    docs, target = spark.createDataFrame(rows, DOC).repartition(6), spark.createDataFrame([(t,) for t in targets], "text string")
    for share, least in ((5, 20), (50, 3), (100, 0)):
        got = importance.resample(docs, target, share=share, least_words=least)
        assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
        assert sorted(str(tuple(r)) for r in got.collect()) == resampled(rows, targets, share, least)
    assert importance.resample(docs, target.limit(0), share=50).count() == len(rows)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(AWKWARD, DOC)
    got = importance.drawn(clashing(docs), docs.select("text"), share=50, least_words=2)
    assert got.columns == clashing(docs).columns and 0 < got.count() < len(AWKWARD)


def test_ranks_follow_the_parts(spark):
    """More parts than rows in some, ties, and equal rows: ranks are 1, 2, 3... all the same."""
    scores = spark.range(3000).selectExpr("id % 700 AS doc_id", "25L AS n_words", "5L AS n_features", "id % 7 AS score", "id AS row").repartition(9)
    got = [r["rank"] for r in importance.ranked(scores, share=100).orderBy(F.desc("score"), "doc_id", "rank").collect()]
    assert got == list(range(1, 3001))


# ---- fill in the middle ----


def arranged(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def lined(rng):
    return "".join(rng.choice(["a", "Zeile ü", "\n", "\n\n", "<", "P>", "<<P", "S>", "<M", "\r", "😀 x", " "]) for _ in range(rng.randrange(0, 30)))


def test_arrangements_by_brute_force(spark):
    rng = random.Random(8)
    rows = AWKWARD + [(100 + i, lined(rng), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    for rate, spm in ((100, 50), (60, 10), (0, 50)):
        made = fill_in_middle.arrange(docs, rate=rate, spm=spm)
        assert sorted(str(tuple(r)) for r in made.collect()) == sorted(str(arranged(r[0], r[1], rate, spm)) for r in rows)
        back = made.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text"))
        assert rows_of(back) == rows_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert {r["form"] for r in fill_in_middle.arrange(docs).collect()} == {"plain", "psm", "spm"}


def test_transform_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(AWKWARD, DOC)
    made = fill_in_middle.transform(clashing(docs).drop("form"))
    assert made.columns == [*[c for c in clashing(docs).columns if c != "form"], "form"]
    assert sorted(str((r["doc_id"], r["text"], r["form"])) for r in made.collect()) == sorted(str((a[0], a[5], a[2])) for a in (arranged(r[0], r[1]) for r in AWKWARD))
    with pytest.raises(ValueError):
        fill_in_middle.transform(clashing(docs), form="FORM")


@pytest.mark.parametrize("name", ["op11", "op12", "op13"])
def test_queries_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    from lectern.llm import queries

    full, fn = next((k, f) for k, f in queries.queries().items() if k.startswith(name + "_"))
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(queries.oracle_sql()[full])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    frame = fn(spark, data)
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())
