"""Files of evaluation: sets of questions, and the stored runs that are compared with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluate
from lectern.storage import materialise

QUESTIONS = "questions array<struct<id:string,category:string,question:string,expect_sources:array<string>,expect_keywords:array<string>,should_answer:boolean>>"
FOUND = {"keyword_rank": "int", "source_rank": "int", "mrr": "double", "top_score": "double", "distinct_documents": "bigint", "n_results": "bigint"}
RESULTS = (
    f"query_id string, category string, should_answer boolean, latency_ms double, error string, found struct<{','.join(map(':'.join, FOUND.items()))}>, "
    "hits struct<source_hit_5:boolean,source_hit_12:boolean,keyword_hit_5:boolean,keyword_hit_12:boolean>"
)
CATEGORIES = "array<struct<category:string,n:bigint,keyword_recall_12:double>>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, category, keywords, sources, should_answer of the files below path, each a document with a list of questions.

    A file that can't be read is an error. Lists that are left out are empty, and a question is to be answered unless it says
    otherwise. A question without an id or a text, and an id that comes twice, are errors, as a run would count them wrongly.
    """
    # a set of questions is one document, so a file is read as a whole
    files = spark.read.schema(QUESTIONS).json(path, multiLine=True, mode="FAILFAST")
    rows = files.select(F.explode("questions").alias("q"))
    empty = F.array().cast("array<string>")
    named = rows.select(
        F.col("q.id").alias("query_id"), F.col("q.question").alias("text"), F.coalesce("q.category", F.lit("")).alias("category"),
        F.coalesce("q.expect_keywords", empty).alias("keywords"), F.coalesce("q.expect_sources", empty).alias("sources"), F.coalesce("q.should_answer", F.lit(True)).alias("should_answer"),
    )
    # every id counts itself: one row goes on for each, and a repeated one fails
    once = named.groupBy("query_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in named.columns[1:]])
    fault: Column = (
        F.when(F.col("query_id").isNull() | (F.trim("query_id") == ""), F.lit("a question without an id"))
        .when(F.col("text").isNull() | (F.trim("text") == ""), F.concat(F.lit("no text in question "), F.col("query_id")))
        .when(F.col("n") > 1, F.concat(F.lit("more than one question "), F.col("query_id")))
    )
    return once.select(F.when(fault.isNull(), F.col("query_id")).otherwise(F.raise_error(fault)).alias("query_id"), *named.columns[1:])


def save(run: DataFrame, path: str, name: str) -> None:
    """Stores a run (the rows of `evaluate.ranks` with category, should_answer, latency_ms and error) as path/run=name.

    `report` is one nested document: the summary and the categories. `results` holds a nested document for each question, in as
    many files as there are tasks, since a set of questions may be of any size. The report is written last and is what makes
    the run count; a run of the same name is replaced. The number of categories is taken to be small.
    """
    if not name or any(c in name for c in "/\\=") or name.startswith("."):
        raise ValueError(f"no name of a run: {name!r}")
    spark, target = run.sparkSession, f"{path.rstrip('/')}/run={name}"
    hits = [f"{kind}_hit_{k}" for kind in ("source", "keyword") for k in (5, 12)]
    nested = run.select(
        F.col("query_id").cast("string"), "category", "should_answer", F.col("latency_ms").cast("double"), "error",
        F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in FOUND.items()]).alias("found"),
        F.struct(*hits).alias("hits"),
    )
    kept = materialise(nested, "run")
    kept.write.mode("overwrite").json(f"{target}/results", ignoreNullFields=False)
    flat = _flat(kept)
    categories = evaluate.by_category(flat).agg(F.array_sort(F.collect_list(F.struct("category", F.col("n").cast("long").alias("n"), F.col("keyword_recall_12").cast("double").alias("keyword_recall_12")))).alias("categories"))
    report = evaluate.summary(flat).select(F.lit(name).alias("name"), F.struct("*").alias("summary")).crossJoin(categories)  # one row each
    report.coalesce(1).write.mode("overwrite").json(f"{target}/report", ignoreNullFields=False)


def _flat(nested: DataFrame) -> DataFrame:
    return nested.select("query_id", "category", "should_answer", "latency_ms", "error", "found.*", "hits.*")


def results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The questions of a stored run, as they were given to `save`; ids are strings."""
    return _flat(spark.read.schema(RESULTS).json(f"{path.rstrip('/')}/run={name}/results", mode="FAILFAST"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """name and summary of every stored run below path, one row each."""
    summary = evaluate.summary(_flat(spark.createDataFrame([], RESULTS))).schema.simpleString()
    kind = f"name string, summary {summary}, categories {CATEGORIES}"
    return spark.read.schema(kind).json(f"{path.rstrip('/')}/run=*/report", mode="FAILFAST")


def compared(spark: SparkSession, path: str, before: str, now: str) -> DataFrame:
    """What changed from one stored run to another, see `evaluate.change`; a name without a run is an error."""
    runs = summaries(spark, path)
    found = {r["name"] for r in runs.filter(F.col("name").isin(before, now)).select("name").collect()}
    for name in (before, now):
        if name not in found:
            raise ValueError(f"no run {name!r} below {path}")
    first, second = (runs.filter(F.col("name") == n).select("summary.*") for n in (before, now))
    return evaluate.change(first, second)
