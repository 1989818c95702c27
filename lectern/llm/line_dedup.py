"""Line deduplication by a segment-partition edit join, native throughout.

Two lines are near copies when their edit distance is at most TAU (2) and the longer has LEAST (10) characters or more, a
similarity of 0.8 or more; shorter lines are copies only when equal. Distinct lines are cut into TAU + 1 even segments, of
which at least one survives TAU edits unharmed. Each line is indexed by (length, segment number, segment)
and probes the indexes of its own and the TAU lengths below at the few places where the segment can lie (the
multi-match-aware windows). Keys that only one line has are dropped before any text is fetched. A key that over
CROWD lines have (a segment of a template) is no work for pairs: of two lines within TAU edits that share a segment the
rests are within TAU edits as well, so the rests are cut into TAU + 1 segments in turn and meet under the pair of segments,
DEPTH times at most; what is crowded then is dealt out in blocks. Pairs under a
key pass an exact bound on letter counts and then a banded bit-parallel automaton: one bit for each diagonal of the band,
one word for each number of errors. Classes are connected components of the links; of each class the line first by
(doc_id, line number) stays.

Only pairs that verify leave the join; texts travel only for lines that share a key with another line.

Lines are cut at line feeds. Blank lines (white space only) are never copies and stay. Nulls: a null text
has no lines; a null doc_id comes first and is a document of its own. Rows with the same doc_id and
text are one document and share its decisions; rows with the same doc_id and other texts are documents of their own. An empty table gives an empty one; further columns, whatever their names, are kept by
`drop_lines` and not read by `classes`.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import HOT, fresh, join_facts, materialise
from lectern.llm.components import components

TAU, LEAST = 2, 10

#: Lines under a key that are compared pair by pair; more are told apart by a further segment, so many times.
CROWD, DEPTH = 2048, 3

#: Documents whose keys tell which keys are hot, about, and the parts that a hot key's lines are dealt out in.
PROBE_DOCS, HOT_PARTS = 2048, 64

#: Line ids that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1 << 21

#: Edges of a task at least where `drop_lines` looks for components.
STAGE_EDGES = 50_000

#: Characters counted one by one in the letter bound.
LETTERS = "etaoinshrdlucmfw" + "gypbvk,. jxqzäéñ"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no (from 0), line: all lines but blank ones. text_key tells texts of one doc_id apart."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.filter(F.col("line").rlike("[^ \\t\\r\\x0B\\f]"))


def identity(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def segment(length: Column, i: int, tau: int = TAU) -> tuple[Column, Column]:
    """Place (from 0) and size of segment i (from 0) of a line of this length; the last ones are the longer."""
    base, longer = F.floor(length / (tau + 1)), length % (tau + 1)
    first = F.lit(tau + 1) - longer
    return i * base + F.greatest(F.lit(0), F.lit(i) - first), base + F.when(F.lit(i) >= first, 1).otherwise(0)


def keys(line: Column, length: Column, tau: int = TAU, rest: bool = False) -> Column:
    """Array of (key, indexed): where the line is indexed (indexed is true) and what it probes; with rest also the line without the segment."""
    out = []
    for shorter in range(tau + 1):
        other = length - shorter
        for i in range(tau + 1):
            at, size = segment(other, i, tau)
            low, high = max(-i, shorter - (tau - i)), min(i, shorter + (tau - i))
            for shift in range(low, high + 1):
                text = F.substr(line, (at + 1 + shift).cast("int"), size.cast("int"))
                parts = [F.xxhash64(F.lit(i), other, text).alias("key"), F.lit(shorter == 0 and shift == 0).alias("indexed")]
                if rest:
                    parts.append(F.concat(F.substr(line, F.lit(1), (at + shift).cast("int")), F.substr(line, (at + 1 + shift + size).cast("int"))).alias("rest"))
                out.append(F.struct(*parts))
    return F.array(*out)


def hot_keys(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """Keys that over one in HOT lines of a few documents have, several lines and one of them indexed. HOT keys of each kind at most.

    What is found changes how the work is dealt out, not the result.
    """
    every = max(1, docs.count() // PROBE_DOCS)
    probe = lines_of(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("line").distinct()
    rows = probe.select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("n")).filter(F.col("n") >= LEAST - tau)
    each = rows.select("id", F.explode(keys(F.col("line"), F.col("n"), tau)).alias("k"))
    seen = each.groupBy("k.key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("k.indexed").alias("any"), F.count("*").alias("n"))
    seen = materialise(seen.filter("low <> high AND any AND n > 8").select("key", "n"), "line-probe")
    return seen.filter(F.col("n") * HOT > probe.count()).select("key")


def shared_keys(each: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The rows of each (key, id, indexed) whose key different lines have, one of them indexed, with their number as crowd.

    The lines of keys in hot, known to be shared and taken as crowded, are dealt out in parts.
    """
    part = F.lit(0).cast("long")
    if hot is not None:
        each = each.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
        part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).otherwise(part)
    by_key = Window.partitionBy("key", "part")
    seen = each.withColumn("part", part).withColumns({"low": F.min("id").over(by_key), "high": F.max("id").over(by_key), "any": F.max("indexed").over(by_key), "crowd": F.count("*").over(by_key)})
    shared = F.col("low") != F.col("high")
    if hot is None:
        return seen.filter(shared & F.col("any")).drop("part", "low", "high", "any")
    seen = seen.filter(F.col("hot") | (shared & F.col("any"))).withColumn("crowd", F.when(F.col("hot"), CROWD + 1).otherwise(F.col("crowd")))
    return seen.drop("part", "low", "high", "any", "hot")


def told_apart(crowded: DataFrame, texts: DataFrame, tau: int = TAU) -> DataFrame:
    """key, id, indexed, crowd under which the lines of crowded keys meet instead: by further segments of what a segment leaves."""
    whole = crowded.select("key", "id", "indexed").distinct().join(texts.select("id", "line", "n"), "id")
    each = whole.select("key", "id", "indexed", F.explode(keys(F.col("line"), F.col("n"), tau, rest=True)).alias("k"))
    rests = each.filter("k.key = key AND k.indexed = indexed").select("key", "id", "indexed", "k.rest")
    done = []
    for depth in range(DEPTH):
        under = rests.select("key", "id", "indexed", F.explode(keys(F.col("rest"), F.length("rest"), tau, rest=True)).alias("k"))
        under = under.select(F.xxhash64("key", "k.key").alias("key"), "id", (F.col("indexed") & F.col("k.indexed")).alias("indexed"), "k.rest")
        seen = materialise(shared_keys(under), "line-rests")
        rests = seen.filter(F.col("crowd") > CROWD)
        if depth == DEPTH - 1 or rests.isEmpty():
            done.append(seen)
            break
        done.append(seen.filter(F.col("crowd") <= CROWD))
    return functools.reduce(DataFrame.unionByName, [d.select("key", "id", "indexed", "crowd") for d in done])


def letter_counts(line: Column, letters: str) -> Column:
    """The counts of sixteen characters, four bits each, in one long."""
    n = F.length(line)
    packed = [F.shiftleft(((n - F.length(F.replace(line, F.lit(c), F.lit("")))) % 16).cast("long"), 4 * i) for i, c in enumerate(letters)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), packed)


def unlike(x: Column, y: Column) -> Column:
    """In how many of sixteen counts x and y differ."""
    d = x.bitwiseXOR(y)
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
    return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))


def within(a: str, b: str, tau: int = TAU) -> Column:
    """Whether the edit distance of two columns is at most tau, by a banded bit-parallel automaton.

    Bit d of word e says: after i characters of a and i + d - tau of b at most e errors were needed. A character
    of a moves all diagonals at once: matching ones stay, an error admits the bit from the word below, unmoved for a
    replacement, one diagonal down for a deletion, one up for an insertion.
    """
    band = 2 * tau + 1
    chars_b = f"split({b}, '')"
    shifted = []
    for d in range(band):
        if d < tau:
            shifted.append(f"concat(array_repeat('', {tau - d}), {chars_b})")
        elif d == tau:
            shifted.append(chars_b)
        else:
            shifted.append(f"slice({chars_b}, {d - tau + 1}, greatest(0, length({b}) - {d - tau}))")
    rows = f"slice(arrays_zip(split({a}, ''), {', '.join(shifted)}), 1, length({a}))"
    match = " | ".join(f"if(z.`{d + 1}` <=> z.`0`, {1 << d}, 0)" for d in range(band))
    full = (1 << band) - 1
    # words before the first character: only insertions
    start = ", ".join(f"{((1 << (e + 1)) - 1) << tau & full} AS r{e}" for e in range(tau + 1))
    new = ["(s.r0 & m)"]
    for e in range(1, tau + 1):
        new.append(f"(((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({new[e - 1]}, 1)) & {full})")
    # m is bound once by a one-element array
    made = ", ".join(f"{x} AS r{e}" for e, x in enumerate(new))
    step = f"CASE WHEN s.r{tau} = 0 THEN s ELSE transform(array({match}), m -> struct({made}))[0] END"
    return F.expr(f"shiftright(aggregate({rows}, struct({start}), (s, z) -> {step}).r{tau}, length({b}) - length({a}) + {tau}) & 1 = 1")


def links(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """u, v: identities of near lines, each link once."""
    distinct = lines_of(docs).groupBy("line").agg(F.count("*").alias("n")).select("line")
    rows = distinct.select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("n")).filter(F.col("n") >= LEAST - tau)
    each = rows.select("id", F.explode(keys(F.col("line"), F.col("n"), tau)).alias("k")).select("id", "k.key", "k.indexed")
    hot = hot_keys(docs, tau)
    shared = materialise(shared_keys(each, None if hot.isEmpty() else hot), "line-keys")
    ids = shared.select("id").distinct()
    if shared.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = lines_of(docs).select("line").withColumn("id", F.xxhash64("line")).join(ids, "id", "left_semi").groupBy("id", "line").agg(F.count("*").alias("n"))
    texts = materialise(texts.select("id", "line", F.length("line").alias("n"), letter_counts(F.col("line"), LETTERS[:16]).alias("c1"), letter_counts(F.col("line"), LETTERS[16:]).alias("c2")), "line-texts")
    crowded = shared.filter(F.col("crowd") > CROWD)
    if not crowded.isEmpty():
        shared = shared.filter(F.col("crowd") <= CROWD).unionByName(told_apart(crowded, texts, tau))
    full = shared.join(texts, "id")
    # a key that is still crowded is dealt out as pairs of parts
    parts = F.ceil(F.col("crowd") / CROWD)
    own, other = F.pmod(F.xxhash64(F.lit("part"), "id"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    left = full.filter("indexed").select("key", own.alias("part"), other.alias("other"), *[F.col(c).alias("l_" + c) for c in ("line", "n", "c1", "c2")])
    right = full.select(F.col("key").alias("r_key"), own.alias("r_part"), other.alias("r_other"), *[F.col(c).alias("r_" + c) for c in ("line", "n", "c1", "c2")])
    close = (
        (F.col("r_n") - F.col("l_n")).between(0, tau)
        & (F.col("r_n") >= LEAST)
        & ((F.col("r_n") > F.col("l_n")) | (F.col("l_line") < F.col("r_line")))
        & (unlike(F.col("l_c1"), F.col("r_c1")) + unlike(F.col("l_c2"), F.col("r_c2")) <= 2 * tau)
    )
    meet = (F.col("key") == F.col("r_key")) & (F.col("part") == F.col("r_other")) & (F.col("other") == F.col("r_part"))
    pairs = left.join(right, meet & F.when(close, within("l_line", "r_line", tau)).otherwise(False))
    return pairs.select(identity(F.col("l_line")).alias("u"), identity(F.col("r_line")).alias("v")).distinct()


def classes(docs: DataFrame, tau: int = TAU, task_edges: int | None = None, small_plans: bool = False) -> DataFrame:
    """Every line that isn't blank: doc_id, line_no, class_doc_id and class_line_no (the line that stays), class_size, n_links, kept, text_key.

    task_edges, small_plans: as for components.
    """
    edges = materialise(links(docs, tau), "line-links")
    roots = materialise(components(edges, task_edges=task_edges, small_plans=small_plans), "line-roots")
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    near = materialise(degree.join(roots, "node", "left"), "line-near")
    own = lines_of(docs).select("doc_id", "text_key", "line_no", identity(F.col("line")).alias("id"))
    # read three times below: written once instead of hashing every line again
    named = materialise(own.join(near, own["id"] == near["node"], "left").select("doc_id", "text_key", "line_no", F.coalesce("root", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-classes")
    line = F.struct("doc_id", "text_key", "line_no")
    first = named.groupBy("class").agg(F.min(line).alias("first"), F.count("*").alias("class_size")).filter("class_size > 1")
    first = materialise(first.withColumn("n", F.col("class_size")), "line-first")
    known = join_facts(named, first, "class", "n", named.count(), ["doc_id", "text_key", "line_no"], "left")
    return known.select(
        "doc_id",
        "line_no",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "n_links",
        (F.col("first").isNull() | line.eqNullSafe(F.col("first"))).alias("kept"),
        "text_key",
    )


def drop_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs with all rows and columns, each text without the lines that are copies of an earlier one."""
    doc, key, lines = (fresh(docs, n) for n in ("__doc", "__text", "__lines"))
    out = classes(docs, tau, STAGE_EDGES, True).filter("NOT kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias(lines))
    out = materialise(out.withColumnsRenamed({"doc_id": doc, "text_key": key}), "line-drops")
    joined = docs.join(out, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(lines), i)), "\n"))
    counted = {"n_chars": F.length("text")} if "n_chars" in docs.columns else {}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return joined.withColumn("text", text).withColumns({c: v.cast(kinds[c]) for c, v in counted.items()}).select(*docs.columns)
