"""A training-data pipeline over `documents`: toxic documents go, repeated lines go, one document of each near-duplicate
group stays, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages are written as Parquet in the shared folder and read again, so each works on all that its predecessor
kept and a lost executor repeats one stage's tasks at most.

Nulls: a null text is kept by the first two stages as it is, counts as an empty text among near duplicates and packs its
end id alone; a null doc_id keeps its row (last of its group, so another row of the group stays instead of it); a null source is a
source. Repeated rows are near duplicates, of which one stays. An empty table passes every stage and packs to no pieces;
without labels no document is toxic. Texts are processed whole, whatever their length. Further columns, whatever their
names, pass the first three stages unchanged and aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import line_dedup, packing, simhash, toxicity
from lectern.llm.common import materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likelier severity grade is 0, scored by a model fitted on the labelled sample of docs; null and empty texts are clean."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that copy an earlier line of the corpus; null texts stay null, texts without lines left become empty."""
    return line_dedup.drop_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their runs of five words the one with the least doc_id; texts without words are one group.

    SimHash links within four bits, found by vantage-point trees, are checked on whole sets; similar documents further apart meet by an exact join.
    """
    return simhash.keep_first(docs, words=5, distance=4, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in mixture-controlled sequences of 2048 tokens; a null text has its end id alone."""
    # executors hold what the stages before left in their heaps and workers, so less is remembered here
    return packing.pack(docs, remember=REMEMBER)


#: Words whose ids a Python worker keeps while packing.
REMEMBER = 100_000

STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("packing", pack_sequences),
]

#: SQL has no ordinal regression, edit joins or SimHash of shingles.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = materialise(out, f"pipeline-{name}")
    return out
