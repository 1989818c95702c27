"""A rule-based linter of reports: every rule is a column of issues (code, severity, message, line, excerpt).

A rule takes the text, or the text with its sections where they are known already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import content_words, let, strip

ISSUE = "struct<code:string,severity:string,message:string,line:int,excerpt:string>"
SEVERITIES = ["error", "warning", "info"]

# Headings, disclaimer, placeholders, measurements, sides and vague sizes.
FINDINGS = r"(?im)^\W*\**\s*findings\s*\**\W*$"
IMPRESSION = r"(?im)^\W*\**\s*(?:impression|conclusion)s?\s*\**\W*$"
DISCLAIMER = r"(?i)\*?\s*draft for radiologist review[^\n]*"
PLACEHOLDERS = r"(?i)\b(?:TODO|TBD|FIXME|XXX+|LOREM IPSUM|INSERT\s+\w+|PATIENT\s*NAME|\[\s*\]|_{3,}|\.{4,})"
UNITLESS = (
    r"(?i)\b(?:measur\w+|approximately|approx\.?|about|up to|size of)\s+"
    r"(\d+(?:\.\d+)?)\s*(?!\s*(?:mm|cm|m\b|millimet|centimet|%|percent|degrees?|°))(?:[a-z]|$)"
)
VAGUE = r"(?i)\b(?:somewhat|fairly|rather|slightly)?\s*(?:enlarged|prominent|increased|decreased|small|large|big)\b(?![^.]{0,40}\b\d)"
LEFT = r"(?i)\bleft\b|\bl\.?[\s-]?sided\b"
RIGHT = r"(?i)\bright\b|\br\.?[\s-]?sided\b"
MEASUREMENT = r"(?i)\b\d+(?:\.\d+)?\s*(?:(?:mm|cm|percent)\b|%)"

# Hedging phrases.
HEDGES = [
    "possibly", "possible", "may represent", "might represent", "could represent",
    "cannot be excluded", "can not be excluded", "cannot be ruled out",
    "suspicious for", "questionable", "probably", "likely", "apparent",
    "seems", "appears to possibly",
]

# Sides have a rule of their own.
COVERED = ["left", "right", "bilateral", "sided"]


def sections(text: Column) -> Column:
    """(findings, impression), cut at the first impression heading."""
    return let(F.split(text, IMPRESSION, 2), lambda p: F.struct(p[0].alias("findings"), F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")).alias("impression")))


def _with_sections(text: Column, s: Column | None, rule: Callable[[Column], Column]) -> Column:
    return rule(s) if s is not None else let(sections(text), rule)


def bare(section: Column) -> Column:
    """A section without headings, disclaimer, bullets and white space."""
    for pattern in (FINDINGS, IMPRESSION, DISCLAIMER, r"[\s\-*•·]"):
        section = F.regexp_replace(section, pattern, "")
    return section


def issue(code: str, severity: str, message: Column | str, line: Column | None = None, excerpt: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"),
        (F.lit(None).cast("string") if excerpt is None else excerpt).alias("excerpt"),
    )


def _some(*conditional: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, i) for c, i in conditional]), lambda x: x.isNotNull())


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def check_sections(text: Column, s: Column | None = None) -> Column:
    has_findings, has_impression = text.rlike(FINDINGS), text.rlike(IMPRESSION)
    return _with_sections(
        text,
        s,
        lambda s: _some(
            (~has_findings, issue("missing_findings", "error", "No FINDINGS section.")),
            (has_findings & (F.length(bare(s["findings"])) < 10), issue("empty_findings", "error", "The FINDINGS section is empty.")),
            (~has_impression, issue("missing_impression", "error", "No IMPRESSION section.")),
            (has_impression & (F.length(bare(s["impression"])) < 10), issue("empty_impression", "error", "The IMPRESSION section is empty.")),
        ),
    )


def _each(text: Column, pattern: str, code: str, severity: str, message: str, trimmed: bool = False) -> Column:
    """An issue for each match, at its line: the feeds before it, plus one."""

    def told(z: Column) -> Column:
        line = lambda i: F.aggregate(F.concat(F.slice(z["before"], 1, i + 1), F.slice(z["inside"], 1, i)), F.lit(1), lambda n, x: n + x)
        return F.transform(z["found"], lambda m, i: issue(code, severity, F.concat(F.lit(message), strip(m)), line(i), strip(m) if trimmed else m))

    found = lambda m: F.struct(m.alias("found"), F.transform(m, _feeds).alias("inside"), F.transform(F.split(text, pattern), _feeds).alias("before"))
    return F.when(text.rlike(pattern), let(let(_matches(text, pattern), found), told)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def check_placeholders(text: Column, s: Column | None = None) -> Column:
    return _each(text, PLACEHOLDERS, "placeholder_text", "error", "A template placeholder was left: ")


def check_units(text: Column, s: Column | None = None) -> Column:
    return _each(text, UNITLESS, "measurement_without_unit", "error", "A measurement has no unit: ", trimmed=True)


def hedges_in(line: Column) -> Column:
    low = F.lower(line)
    return F.filter(F.array(*[F.when(low.contains(h), F.lit(h)) for h in HEDGES]), lambda x: x.isNotNull())


def check_hedging(text: Column, s: Column | None = None) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("n"), hedges_in(x).alias("hits")))
    return F.transform(
        F.filter(lines, lambda x: F.size(x["hits"]) >= 2),
        lambda x: issue("stacked_hedging", "warning", F.concat(F.lit("Several hedges in one statement: "), F.array_join(F.slice(x["hits"], 1, 3), ", ")), x["n"], F.left(strip(x["line"]), F.lit(120))),
    )


def check_laterality(text: Column, s: Column | None = None) -> Column:
    def rule(s: Column) -> Column:
        f_left, f_right, i_left, i_right = (s[x].rlike(p) for x in ("findings", "impression") for p in (LEFT, RIGHT))
        return _some(
            (i_left & ~f_left & f_right, issue("laterality_mismatch", "error", "The impression says LEFT, the findings only RIGHT.")),
            (i_right & ~f_right & f_left, issue("laterality_mismatch", "error", "The impression says RIGHT, the findings only LEFT.")),
        )

    return _with_sections(text, s, rule)


def _token(match: Column) -> Column:
    return F.replace(F.lower(match), F.lit(" "), F.lit(""))


def check_measurements(text: Column, s: Column | None = None) -> Column:
    def rule(s: Column) -> Column:
        known = F.transform(_matches(s["findings"], MEASUREMENT), _token)
        new = let(known, lambda k: F.filter(_matches(s["impression"], MEASUREMENT), lambda m: ~F.array_contains(k, _token(m))))
        return F.transform(new, lambda m: issue("impression_measurement_not_in_findings", "error", F.concat(F.lit("The impression states a measurement that the findings lack: "), m), excerpt=m))

    return _with_sections(text, s, rule)


def _novel(own: Column, known: Column) -> Column:
    """Words of own that share no beginning with a known one: five characters, or all four of a word of four."""

    def rule(k: Column) -> Column:
        told = lambda w: (
            F.array_contains(k["whole"], w)
            | F.when(F.length(w) == 4, F.array_contains(k["four"], w)).otherwise(F.array_contains(k["five"], F.left(w, F.lit(5))) | F.array_contains(k["short"], F.left(w, F.lit(4))))
        )
        return F.filter(own, lambda w: ~told(w))

    beginnings = lambda k: F.struct(
        k.alias("whole"),
        F.array_distinct(F.transform(k, lambda w: F.left(w, F.lit(5)))).alias("five"),
        F.array_distinct(F.transform(k, lambda w: F.left(w, F.lit(4)))).alias("four"),
        F.filter(k, lambda w: F.length(w) == 4).alias("short"),
    )
    return let(let(known, beginnings), rule)


def introduced_terms(text: Column, s: Column | None = None) -> Column:
    """Content words of the impression that share no beginning with a word of the findings."""

    def rule(s: Column) -> Column:
        impression = F.regexp_replace(s["impression"], DISCLAIMER, "")
        own = F.array_sort(F.filter(content_words(impression), lambda w: ~w.isin(*COVERED)))
        return F.when((strip(s["findings"]) != "") & (strip(impression) != ""), _novel(own, content_words(s["findings"]))).otherwise(F.array().cast("array<string>"))

    return _with_sections(text, s, rule)


def check_terms(text: Column, s: Column | None = None) -> Column:
    return let(
        introduced_terms(text, s),
        lambda novel: _some((F.size(novel) > 0, issue("impression_introduces_term", "warning", F.concat(F.lit("Terms appear in the impression alone: "), F.array_join(F.slice(novel, 1, 6), ", "))))),
    )


def check_vague_sizes(text: Column, s: Column | None = None) -> Column:
    return _with_sections(text, s, lambda s: _each(s["findings"], VAGUE, "unquantified_size", "info", "A size has no measurement: ", trimmed=True))


#: In the order in which issues of equal severity and line are told.
RULES = [check_sections, check_placeholders, check_units, check_hedging, check_laterality, check_measurements, check_terms, check_vague_sizes]


def issues(text: Column) -> Column:
    """All issues of a report, by severity, line and rule; a blank report has one."""
    text = F.coalesce(text, F.lit(""))
    found = let(sections(text), lambda s: F.concat(*[rule(text, s) for rule in RULES]))
    # array_sort is stable in none of its contracts, so the place is part of the key
    ranked = F.transform(found, lambda x, i: F.struct(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), x["severity"]).alias("r"), F.coalesce(x["line"], F.lit(0)).alias("l"), i.alias("i"), x.alias("issue")))
    ordered = F.transform(F.array_sort(ranked), lambda x: x["issue"])
    empty = F.array(issue("empty_report", "error", "The report is empty.", F.lit(None), F.lit(None)))
    return F.when(strip(text) == "", empty.cast(f"array<{ISSUE}>")).otherwise(ordered.cast(f"array<{ISSUE}>"))


def _severity_is(severity: str) -> Callable[[Column], Column]:
    return lambda x: x["severity"] == severity


def lint(reports: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, issues, errors, warnings, is_clean (no error and no warning)."""
    found = reports.select(key, issues(F.col(text)).alias("issues"))

    def counts(x: Column) -> Column:
        number = {s: F.size(F.filter(x, _severity_is(s))) for s in SEVERITIES[:2]}
        return F.struct(x.alias("issues"), *[n.alias(s) for s, n in number.items()])

    # bound once: the issues would be computed again for every count
    counted = found.select(key, let(F.col("issues"), counts).alias("r"))
    return counted.select(key, "r.issues", F.col("r.error").alias("errors"), F.col("r.warning").alias("warnings"), ((F.col("r.error") == 0) & (F.col("r.warning") == 0)).alias("is_clean"))
