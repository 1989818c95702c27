"""Column functions on text. Patterns keep to ASCII classes, so every engine reads them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
SEARCH_STOPWORDS = """
a an and are as at be been by for from has have how in into is it its of on
or that the their there these this to was were what when where which who
why will with would you your do does did can could should
""".split()

# Words that carry no content in a report.
REPORT_STOPWORDS = """
a an and are as at be but by for from has have in into is it its no not of on
or that the there these this to was were with without within
""".split()

# Words that don't tell where a measurement belongs.
CONTEXT_STOPWORDS = """
a an and are as at be by for from has have in into is it its measuring measures
no not of on or that the there these this to up was were with within about
approximately size seen noted demonstrates shows there compared previously now
previous prior current interval study exam examination
""".split()

# A query that holds one of these is in scope.
IN_SCOPE = [
    "radiolog", "radiograph", "x-ray", "xray", "ct ", "mri", "ultrasound",
    "imaging", "scan", "contrast", "chest", "lung", "pulmonar", "cardiac",
    "abdom", "pleural", "pneumo", "fracture", "nodule", "lesion", "mass",
    "effusion", "embol", "stroke", "haemorrhage", "hemorrhage", "infarct",
    "diagnos", "differential", "findings", "patient", "clinical", "report",
    "anatomy", "patholog", "tumour", "tumor", "cancer", "artery", "vein",
    "bone", "brain", "liver", "kidney", "spine", "trauma", "sepsis",
    "oedema", "edema", "consolidation", "opacity", "modality", "sign",
]

# What a query out of scope looks like.
OUT_OF_SCOPE = [
    r"\bweather\b",
    r"\btell me a joke\b",
    r"\bwho (won|is winning)\b.*\b(game|match|cup|election)\b",
    r"\bstock (price|market)\b",
    r"\b(recipe|cook|bake)\b",
    r"\bwrite (me )?(a )?(poem|song|story)\b",
    r"\btranslate\b.*\bto (spanish|french|german|urdu|chinese)\b",
    r"\bwhat('s| is) the capital of\b",
    r"\bsports? scores?\b",
]

# How an answer that declines begins or goes.
REFUSALS = ["don't have enough information", "designed to assist with radiology"]

SPACE = r"[ \t\n\r\x0B\f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; an expression inside a lambda would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space (SPACE) at both ends; SQL's trim would take blanks alone, a pattern would be tried at every character."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def words(text: Column, pattern: str, stopwords: list[str], least: int = 1) -> Column:
    """Matches of pattern in the lower-cased text that are long enough and no stopwords, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*dict.fromkeys(stopwords)))


def tokenize(text: Column) -> Column:
    """Search terms: runs of a-z and digits of two or more characters, no stopwords."""
    return words(text, "[a-z0-9]+", SEARCH_STOPWORDS, 2)


def content_words(text: Column) -> Column:
    return F.array_distinct(words(text, "[a-z]{4,}", REPORT_STOPWORDS))


def context_words(text: Column) -> Column:
    return F.array_distinct(words(text, "[a-z]{3,}", CONTEXT_STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def agreement(reading: Column, check: Column) -> Column:
    """The share of the first reading's tokens that the second has; null if the first has none."""
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9%]+"), 0)) for x in (reading, check))
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, b)) / F.size(a), 3))


def out_of_scope(query: Column) -> Column:
    low = strip(F.lower(query))
    inside = F.lit(False)
    for word in IN_SCOPE:
        inside = inside | low.contains(word)
    return ~inside & low.rlike("|".join(f"(?:{p})" for p in OUT_OF_SCOPE))


def refuses(answer: Column) -> Column:
    low, out = F.lower(F.coalesce(answer, F.lit(""))), F.lit(False)
    for mark in REFUSALS:
        out = out | low.contains(mark)
    return out


def plain_citations(text: Column) -> Column:
    """Full-width citation brackets as ASCII ones."""
    return F.translate(text, "【】［］", "[][]")


def citation_valid(inside: Column, sources: Column) -> Column:
    """Whether every number of a citation's inside, such as `1, 3`, names one of the sources."""
    parts = F.transform(F.split(inside, ","), lambda x: strip(x).try_cast("int"))
    return (F.size(parts) > 0) & F.forall(parts, lambda n: n.isNotNull() & (n >= 1) & (n <= sources))


def contextualise(title: Column, filename: Column, chunk: Column) -> Column:
    """The text that is embedded: `label. chunk`, or the chunk alone without a label."""
    label = F.coalesce(F.nullif(strip(title), F.lit("")), F.nullif(strip(filename), F.lit("")))
    return F.concat_ws(". ", label, chunk)


def final_text(draft: Column, edited: Column) -> Column:
    return F.coalesce(edited, draft)


def was_edited(draft: Column, edited: Column) -> Column:
    """Whether an edit changes more than white space at the ends; no edit changes nothing."""
    return F.coalesce(strip(edited) != strip(draft), F.lit(False))


def title_of(filename: Column) -> Column:
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def stream_event(kind: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def stream_decode(frame: Column) -> Column:
    """(event, data) of one server-sent event."""
    return F.struct(F.regexp_extract(frame, r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(frame, r"(?m)^data: (.*)$", 1).alias("data"))


def normalise_email(email: Column) -> Column:
    return F.lower(strip(email))


def client_address(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.split(forwarded, ",")[0]), F.lit("")), peer, F.lit("unknown"))


def merged(before: Column, after: Column) -> Column:
    """Two maps of metadata as one; where both have a key the later value counts, unless it is null."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(before, none), F.coalesce(after, none), lambda k, x, y: F.coalesce(y, x))


def parse_reply(reply: Column) -> Column:
    """(transcription, unclear) of a model's reply: JSON, in a code fence or amid prose, else the raw text."""
    bare = strip(F.regexp_replace(reply, r"(?m)^```(?:json)?\s*|```\s*$", ""))
    found = F.coalesce(bare, F.lit(""))
    inner = F.regexp_extract(found, r"(?s)\{.*\}", 0)
    kind = "transcription string, unclear array<struct<reads_as:string,possible:array<string>,matters_because:string>>"
    parsed = F.coalesce(F.when(found.startswith("{"), F.from_json(found, kind)), F.from_json(F.nullif(inner, F.lit("")), kind))
    return F.when(parsed["transcription"].isNotNull(), parsed).otherwise(F.struct(reply.alias("transcription"), F.lit(None).cast("array<struct<reads_as:string,possible:array<string>,matters_because:string>>").alias("unclear")))
