"""Prompts from ranked sources: which instructions apply, and how sources and documents are laid out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ["qa", "report", "report_analysis", "comparison"]
AUDIENCES = ["radiologist", "resident"]

ROLES = {
    "qa:radiologist": "You help attending radiologists to decide. Be direct and use the field's terms.",
    "qa:resident": "You teach radiology to residents. Reason step by step and explain rare terms.",
    "report": "Turn the dictated findings into a report with the sections FINDINGS and IMPRESSION.",
    "report_analysis": "Explain the uploaded document. It is about one patient; the literature is not.",
    "comparison": "Tell what changed between the two studies. Differences that were computed are settled facts.",
}

GROUNDING = {
    "qa": "Answer from the context alone and say so if it doesn't suffice. Cite each claim as [1]. Assert no diagnosis.",
    "report": "The dictation is the only source of content. Cite nothing in the report.",
    "report_analysis": "Answer from the context alone and say so if it doesn't suffice. Cite each claim as [1]. Assert no diagnosis.",
    "comparison": "The two reports are the only sources about the patient. Cite background only to explain a term.",
}

RULE = "=" * 60


def mode_of(mode: Column, prior: Column, attached: Column) -> Column:
    """The mode that applies: a prior study means comparison, an attached document its analysis."""
    return (
        F.when((mode == "comparison") | (F.coalesce(prior, F.lit("")) != ""), "comparison")
        .when(mode == "report", "report")
        .when((mode == "report_analysis") | (F.coalesce(attached, F.lit("")) != ""), "report_analysis")
        .when(mode == "qa", "qa")
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode "), F.coalesce(mode, F.lit("null")))).cast("string"))
    )


def source_header(number: Column, title: Column, kind: Column, score: Column) -> Column:
    return F.format_string("[%d] %s (%s, score %.2f)", number.cast("int"), F.coalesce(title, F.lit("Unknown")), F.coalesce(kind, F.lit("general")), score)


def context_block(sources: Column) -> Column:
    """sources: array of (chunk_id, title, source_type, score, text) in order."""
    each = F.transform(sources, lambda s: F.concat(source_header(s["chunk_id"], s["title"], s["source_type"], s["score"]), F.lit("\n"), s["text"], F.lit("\n")))
    return F.when(F.size(sources) > 0, F.concat(F.lit("\nSOURCES TO ANSWER FROM:\n\n"), F.array_join(each, "\n"))).otherwise("\n\nThe knowledge base holds no source for this question.")


def framed(title: str, text: Column, end: str) -> Column:
    body = F.concat(F.lit(f"\n\n{RULE}\n{title}\n{RULE}\n"), text, F.lit(f"\n{RULE}\n{end}\n"))
    return F.when(F.coalesce(text, F.lit("")) != "", body).otherwise("")


def warnings_block(warnings: Column) -> Column:
    listed = F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("  - "), w)), "\n")
    return F.when(F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\nThe text was read by a machine and may hold errors:\n"), listed, F.lit("\n"))).otherwise("")


def system_message(mode: Column, audience: Column, sources: Column, attached: Column, warnings: Column, prior: Column, facts: Column) -> Column:
    """Role, grounding, prior study with computed facts, uploaded document, context: in this order."""
    own = mode_of(mode, prior, attached)
    reader = F.when(audience.isin(*AUDIENCES), audience).otherwise("radiologist")
    role, ground = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, text in ROLES.items():
        m, _, a = key.partition(":")
        role = F.when((own == m) & ((reader == a) if a else F.lit(True)), text).otherwise(role)
    for m, text in GROUNDING.items():
        ground = F.when(own == m, text).otherwise(ground)
    told = F.when((F.coalesce(prior, F.lit("")) != "") & (F.coalesce(facts, F.lit("")) != ""), F.concat(F.lit("\n"), facts, F.lit("\n"))).otherwise("")
    before = F.concat(framed("EARLIER REPORT", prior, "EARLIER REPORT ENDS"), told)
    document = F.concat(framed("ATTACHED TEXT", attached, "ATTACHED TEXT ENDS"), F.when(F.coalesce(attached, F.lit("")) != "", warnings_block(warnings)).otherwise(""))
    return F.concat(role, F.lit("\n\n"), ground, before, document, F.lit("\n"), context_block(sources))


def answer_events(sources: Column, tokens: Column) -> Column:
    """The ordered events of an answer: sources, tokens with plain citation brackets, done."""
    from lectern.functions.text import plain_citations

    first = F.array(F.struct(F.lit("sources").alias("event"), F.to_json(sources).alias("data")))
    each = F.transform(tokens, lambda t: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(plain_citations(t).alias("text"))).alias("data")))
    last = F.array(F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data")))
    return F.concat(first, each, last)
