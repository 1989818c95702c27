"""Line dedup, exact dedup and SimHash against brute force, with the awkward rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import components, exact_dedup, line_dedup, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty texts, ties and repeated rows
AWKWARD = [
    (None, "no id here at all", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "one two three four five six", "en", "s", 27),
    (4, "One  two\tthree four FIVE six", "en", "s", 28),
    (5, "one two three four five six", "en", "s", 27),
    (5, "one two three four five six", "en", "s", 27),
    (6, "wörds ünd mehr\n\nzeile\nwörds ünd mehr", "de", "t", 5),
    (6, "another text under the same id", "de", "t", 5),
]


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(chars) + 1) if chars else 0
        if kind == 0:
            chars.insert(at, rng.choice("abcéß x"))
        elif chars:
            at = min(at, len(chars) - 1)
            chars[at : at + 1] = [] if kind == 1 else rng.choice("abcéß x")
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def roots(nodes, pairs):
    of = {n: n for n in nodes}

    def find(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        of[y] = x
    return {n: find(n) for n in nodes}


def test_bit_parallel_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("", "abc")]
    for _ in range(300):
        a = "".join(rng.choice("abcdé ß") for _ in range(rng.randrange(40)))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", line_dedup.within("a", "b").alias("w")).collect()
    assert {r["i"]: r["w"] for r in rows} == {i: distance(a, b) <= 2 for i, (a, b) in enumerate(pairs)}


def test_lines_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghé ß") for _ in range(rng.randrange(6, 40))) for _ in range(25)]
    lines = [edited(rng, rng.choice(base), rng.randrange(4)).replace("\n", "") for _ in range(160)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(20)], "doc_id long, text string")
    occ = [(i // 8, i % 8, x) for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
    distinct = sorted({x for *_, x in occ})
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if max(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    of = roots(distinct, pairs)
    first = {}
    for d, n, x in occ:
        first.setdefault(of[x], (d, n))
    links = {x: sum(x in p for p in pairs) for x in distinct}
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_dedup.classes(docs).collect()}
    assert len(pairs) > 50
    assert got == {(d, n): (*first[of[x]], links[x], first[of[x]] == (d, n)) for d, n, x in occ}


@pytest.mark.parametrize(("crowd", "depth"), [(3, 1), (3, 3), (40, 2)])
def test_crowded_segments_lose_no_link(spark, monkeypatch, crowd, depth):
    """Lines of a template, which share a segment that says nothing, against all pairs."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "DEPTH", depth)
    monkeypatch.setattr(line_dedup, "HOT_PARTS", 3)
    rng = random.Random(12)
    lines = set()
    for _ in range(30):
        base = "the same beginning of them all: " + "".join(rng.choice("abcdef") for _ in range(rng.randrange(12)))
        lines |= {edited(rng, base, rng.randrange(3)) for _ in range(4)}
    lines |= {"a" * n for n in range(9, 16)} | {edited(rng, "aaaaaaaaaaaa", 1) for _ in range(12)}
    lines = sorted(x.replace("\n", "") for x in lines)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert not line_dedup.hot_keys(docs).isEmpty()
    pairs = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if max(len(a), len(b)) >= 10 and distance(a, b) <= 2}
    name = {r["id"]: r["line"] for r in docs.select(line_dedup.identity(F.col("text")).alias("id"), F.col("text").alias("line")).collect()}
    found = [tuple(sorted((name[r["u"]], name[r["v"]]))) for r in line_dedup.links(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_awkward_lines(spark):
    docs = spark.createDataFrame(AWKWARD, DOC).withColumn("__doc", F.lit(1))
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    rows = sorted(out.collect(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] != 6}
    assert by[None] == "no id here at all" and by[1] is None and by[2] == "" and by[5] == ""
    assert {r["text"] for r in rows if r["doc_id"] == 6} == {"wörds ünd mehr\n\nzeile", "another text under the same id"}
    assert line_dedup.classes(docs.limit(0)).count() == 0
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_long_line(spark):
    long = "word " * 4000
    docs = spark.createDataFrame([(1, long + "end"), (2, long + "and"), (3, "x" * 9), (4, "x" * 8)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_doc_id"], r["n_links"]) for r in line_dedup.classes(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rng = random.Random(3)
    rows = AWKWARD + [(10 + i, " ".join(rng.choice(["a", "b", "c "]) for _ in range(rng.randrange(4))), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, DOC).repartition(5).write.parquet(path)
    return path, rows


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup(spark, table, bits):
    """Also with a digest of one hexadecimal digit: full bytes tell clashing texts apart."""
    path, rows = table
    digest = exact_dedup.sha256 if bits == 64 else lambda c: F.substring(F.sha2(c, 256), 1, 1)
    norm = lambda t: (t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    keep = {n: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for n, g in groups.items()}
    import hashlib

    expected = sorted((str(r[0]), str(keep[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    found = exact_dedup.deduplicate(spark, path, digest).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(2, "a b"), (3, "c")], "doc_id long, text string").write.parquet(path)
    exact_dedup.fold(spark, path, checkpoint=log).count()
    spark.createDataFrame([(1, "ab"), (0, "a  b")], "doc_id long, text string").write.mode("append").parquet(path)
    got = {(r["group_size"], -r["best"]["neg_id"]) for r in exact_dedup.fold(spark, path, checkpoint=log).collect()}
    assert got == {(3, 0), (1, 3)}


def test_exact_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "in"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "in")).count() == 0


def plain_fingerprint(text, words=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    own = re.findall("[^\x20\x09-\x0d]+", low)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(4)
    texts = ["", " \t", "a", "A b", "İ ß É", "x" * 500, " ".join("w" * rng.randrange(1, 60) for _ in range(300))]
    texts += [" ".join(rng.choice(["ab", "Cde", "é", " ", "z" * 40]) for _ in range(rng.randrange(30))) for _ in range(200)]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]


def near_fingerprints(rng, clusters, size):
    out = []
    for _ in range(clusters):
        center = rng.getrandbits(64)
        for _ in range(size):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("shard", "block"), [(8192, 16_384), (32, 16)])
def test_tree_finds_every_link(spark, monkeypatch, shard, block):
    """Also with many small shards and blocks."""
    for name, value in (("SHARD", shard), ("BLOCK_POINTS", block), ("BLOCK_ASKERS", 4 * block), ("PLAIN", 256)):
        monkeypatch.setattr(simhash, name, value)
    fps = near_fingerprints(random.Random(5), 60, 10)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    a = np.array(fps, np.uint64)
    pairs = [(signed[i], signed[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if i < j]
    assert roots(signed, [(r["u"], r["v"]) for r in edges]) == roots(signed, pairs)


def test_near_duplicates(spark):
    docs = spark.createDataFrame(AWKWARD, DOC)
    fps = [(r[0], plain_fingerprint(r[1] or "")) for r in AWKWARD]
    of = roots(range(len(fps)), [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and bin(a[1] ^ b[1]).count("1") <= 4])
    ids = {}
    for i, (d, _) in enumerate(fps):
        ids.setdefault(of[i], []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    expected = sorted((str(d), f"{f:016x}", str(least[of[i]])) for i, (d, f) in enumerate(fps))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash.near_duplicates(docs).collect()) == expected
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len(ids)
    assert sum(r["doc_id"] == 3 for r in kept) == 1 and not any(r["doc_id"] in (4, 5) for r in kept)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def plain_set(text, words=5):
    own = text.lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


@pytest.mark.parametrize("block", [2048, 3])
def test_stage_keeps_one_of_similar_documents(spark, monkeypatch, block):
    """The pipeline's stage against all pairs, also with groups in many parts."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(4, 90))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "new"
            texts.append(" ".join(own[rng.randrange(3) :]))
    # long texts, which fill many counts, unlike but for a passage that many share
    passage = [f"p{i}" for i in range(60)]
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1500, 2600))]
        texts += [" ".join(base + passage), " ".join(base[: rng.randrange(1000, 1500)] + passage), " ".join(base[len(base) // rng.randrange(6, 12) :] + passage)]
    texts += ["common words in every row of all " + f"{i} " * 40 for i in range(10)]
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in pairs if bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 4]
    assert len(far) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    kept = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == set(roots(range(len(texts)), pairs).values())


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage computes fingerprints of runs of five words and asks the tree for all within four bits."""
    import corpus_pipeline

    asked = []
    tree = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, distance: asked.append((sorted(r[0] & (1 << 64) - 1 for r in distinct.collect()), distance)) or tree(distinct, distance))
    rng = random.Random(8)
    texts = ["", None, "A b"]
    for _ in range(15):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(100, 400))]
        texts += [" ".join(base), " ".join(base[rng.randrange(1, 4) :]), " ".join([*base, "end"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)
    prints = [plain_fingerprint(t or "", 5) for t in texts]
    kept = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert asked == [(sorted(set(prints)), 4)]
    sets = [plain_set(t or "") for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert {r["doc_id"] for r in kept} == set(roots(range(len(texts)), pairs).values())
    # what the tree links meets: each class of several sets under one key
    table = simhash.shingle_sets(docs, 5)
    of = {r["doc_id"]: r["fp"] for r in table.collect()}
    linked = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    classes = {frozenset(of[j] for j in linked if linked[j] == k) for k in linked.values()}
    met = {}
    for r in simhash.near_prints(table, 4).collect():
        met.setdefault(r["key"], set()).add(r["fp"])
    assert {frozenset(m) for m in met.values()} == {c for c in classes if len(c) > 1} and len(met) > 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_meet_their_facts_in_parts(spark, monkeypatch, how):
    from lectern.llm import common

    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(i, 1 if i < 60 else i) for i in range(100)], "i int, k int")
    facts = spark.createDataFrame([(1, 60, "hot")] + [(k, 1, "one") for k in range(60, 99)], "k int, n long, fact string")
    got = sorted((r["i"], r["fact"]) for r in common.join_facts(rows, facts, "k", "n", 100, ["i"], how).collect())
    assert got == [(i, "hot" if i < 60 else "one") for i in range(99)] + ([(99, None)] if how == "left" else [])


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(chain + star + loose, "u long, v long"))
    pairs = [p for p in chain + star + loose if None not in p]
    of = roots({n for p in pairs for n in p}, pairs)
    assert {r["node"]: r["root"] for r in found.collect()} == {n: r for n, r in of.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("stage", ["dedup_lines", "dedup_documents"])
def test_no_plan_of_the_pipeline_holds_a_round_of_components(spark, monkeypatch, stage):
    """What a star reads twice is written first: the driver plans one aggregate and one join at a time. Few tasks write a small graph."""
    import corpus_pipeline

    held, written = [], components.materialise

    def write(df, tag):  # noqa: ANN001, ANN202
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        held.append((tag, plan.count("Aggregate ["), plan.count("Join ")))
        return written(df, tag)

    monkeypatch.setattr(components, "materialise", write)
    texts = [" ".join(f"w{i // 4}x{j}" for j in range(30)) + (f" end{i % 4}" if i % 4 else "") for i in range(24)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    assert getattr(corpus_pipeline, stage)(spark, docs, "").count() == (24 if stage == "dedup_lines" else 6)
    rounds = [h for h in held if h[0] == "stars"]
    assert rounds and all(aggregates <= 1 and joins <= 2 for _, aggregates, joins in rounds)
    # the last step of a round: one join with the facts, one with the hot keys, a distinct
    firsts = [i for i, h in enumerate(held) if h[0] == "edges" and i and held[i - 1][0] == "stars"]
    assert firsts and all(held[i][1] <= 1 and held[i][2] <= 2 for i in firsts)


@pytest.mark.parametrize("small_plans", [False, True])
def test_components_by_small_plans(spark, small_plans):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(400, 440)]
    found = components.components(spark.createDataFrame(pairs, "u long, v long"), task_edges=10, small_plans=small_plans)
    of = roots({n for p in pairs for n in p}, pairs)
    assert {r["node"]: r["root"] for r in found.collect()} == {n: r for n, r in of.items() if n != r}


def test_many_ids_of_the_stage_are_not_broadcast(spark):
    hinted = lambda n: "ResolvedHint" in simhash.small_ids(spark.range(n), simhash.STAGE_IDS)._jdf.queryExecution().analyzed().toString()
    assert hinted(1000) and not hinted(1 << 15)


def test_the_least_and_greatest_ids(spark, tmp_path):
    """The least long has no negative; of equal texts it stays."""
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "same text"), (high, "same  text"), (0, "sametext"), (low, "other"), (None, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(exact_dedup.deduplicate(spark, str(tmp_path / "documents.parquet")).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(low, high, 3, False), (high, high, 3, True), (0, high, 3, False), (low, low, 2, True), (None, low, 2, False)]))
