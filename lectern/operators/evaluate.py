"""Retrieval quality: ranks of first hits, recall, reciprocal ranks, and the change from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rank(results: DataFrame, text: str, wanted: str, alias: str) -> Column:
    """The least rank whose text holds one of the wanted phrases, in any case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.min(F.when(F.exists(wanted, lambda w: low.contains(F.lower(w))), F.col("rank"))).alias(alias)


def ranks(questions: DataFrame, results: DataFrame, by: str = "query_id") -> DataFrame:
    """Of each question: keyword_rank, source_rank, hits at 5 and 12, mrr, top_score and distinct_documents.

    questions: by, keywords, sources (arrays) and what else there is; results: by, rank, text, title, document_id, score.
    """
    joined = questions.join(results, by, "left")
    kept = [c for c in questions.columns if c not in (by, "keywords", "sources")]
    out = joined.groupBy(by, *kept).agg(
        first_rank(joined, "text", "keywords", "keyword_rank"),
        first_rank(joined, "title", "sources", "source_rank"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("top_score"),
        # a null document is one document
        F.count_distinct(F.when(F.col("rank").isNotNull(), F.coalesce(F.col("document_id").cast("string"), F.lit("")))).alias("distinct_documents"),
        F.count("rank").alias("n_results"),
    )
    for kind in ("source", "keyword"):
        for k in (5, 12):
            out = out.withColumn(f"{kind}_hit_{k}", F.coalesce(F.col(f"{kind}_rank") <= k, F.lit(False)))
    return out.withColumn("mrr", F.coalesce(1 / F.col("keyword_rank"), 1 / F.col("source_rank"), F.lit(0.0)))


def percent(flag: str) -> Column:
    answerable = F.col("should_answer")
    return F.coalesce(F.round(100 * F.count_if(answerable & F.col(flag)) / F.nullif(F.count_if(answerable), F.lit(0)), 1), F.lit(0.0))


def summary(rows: DataFrame) -> DataFrame:
    """One row of a run: shares and means over answerable questions, latency and errors over all."""

    def mean(column: str, digits: int) -> Column:
        return F.coalesce(F.round(F.avg(F.when(F.col("should_answer"), F.col(column))), digits), F.lit(0.0))

    return rows.agg(
        F.count("*").alias("n_questions"),
        F.count_if("should_answer").alias("n_answerable"),
        *[percent(f"{kind}_hit_{k}").alias(f"{kind}_recall_{k}") for kind in ("source", "keyword") for k in (5, 12)],
        mean("mrr", 3).alias("mrr"),
        mean("top_score", 3).alias("mean_top_score"),
        mean("distinct_documents", 1).alias("mean_distinct_docs"),
        F.coalesce(F.round(F.median("latency_ms")), F.lit(0.0)).alias("median_latency_ms"),
        F.count("error").alias("errors"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    return rows.filter("should_answer").groupBy("category").agg(F.count("*").alias("n"), F.round(100 * F.count_if("keyword_hit_12") / F.count("*"), 1).alias("keyword_recall_12"))


# From which recall in percent on a category is good, or fair.
GOOD, FAIR = 80, 50


def banded(categories: DataFrame) -> DataFrame:
    """The categories' recall with its band."""
    recall = F.col("keyword_recall_12")
    return categories.withColumn("band", F.when(recall >= GOOD, "good").when(recall >= FAIR, "fair").otherwise("poor"))


def errors(rows: DataFrame) -> DataFrame:
    """Each error with its number and the first three questions."""
    failed = rows.filter("error IS NOT NULL").select("error", "query_id")
    # the limit applies before rows are shuffled, so an error of very many questions sends three from each task
    order = Window.partitionBy("error").orderBy("query_id")
    first = failed.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").groupBy("error").agg(F.array_sort(F.collect_list("query_id")).alias("examples"))
    return failed.groupBy("error").agg(F.count("*").alias("n")).join(first, "error")


def change(before: DataFrame, now: DataFrame) -> DataFrame:
    """metric, before, now, delta, better: what changed between two summaries; a latency is better when it falls."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in df.columns)
        return df.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (metric, {name})")

    both = long(before, "before").join(long(now, "now"), "metric").withColumn("delta", F.round(F.col("now") - F.col("before"), 3))
    return both.filter("delta <> 0").withColumn("better", F.when(F.col("metric").contains("latency"), F.col("delta") < 0).otherwise(F.col("delta") > 0))


#: Phrases without a whole word inside that are looked for by scanning.
MOST_SHORT = 1000


def containing(phrases: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """The phrases (column phrase) that some text of the corpus holds, in any case, each once.

    A text that holds a phrase has all words that lie whole inside it; candidates meet under the longest of them. Phrases
    of one or two words have none: these few are looked for in every text.
    """
    wanted = phrases.select("phrase").filter(F.col("phrase").isNotNull()).distinct()
    # words that touch neither end are words of any text around the phrase
    inner = F.regexp_extract_all(F.lower("phrase"), F.lit("[^a-z0-9]([a-z0-9]+)(?=[^a-z0-9])"), 1)
    longest = F.try_element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    keyed = wanted.withColumn("term", longest)
    terms = corpus.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), 0))).alias("term"))
    candidates = terms.join(keyed.filter("term IS NOT NULL"), "term").select(key, "phrase")
    found = candidates.join(corpus.select(key, "text"), key).filter(F.lower("text").contains(F.lower("phrase"))).select("phrase")
    short = keyed.filter("term IS NULL").select("phrase")
    n = short.count()
    if n > MOST_SHORT:
        raise ValueError(f"{n} phrases hold no whole word inside; at most {MOST_SHORT} can be looked for at once")
    if n:
        # at most MOST_SHORT rows meet each text
        found = found.unionByName(corpus.join(F.broadcast(short), F.lower("text").contains(F.lower("phrase"))).select("phrase"))
    return found.distinct()


def keyword_status(phrases: DataFrame, retrieved: DataFrame, corpus: DataFrame, key: str, by: str = "query_id") -> DataFrame:
    """by, phrase, status: retrieved, in corpus but missed, or not in corpus. key: of the corpus's texts."""
    hit = phrases.join(retrieved, by).filter(F.lower("text").contains(F.lower("phrase"))).select(by, "phrase").distinct().withColumn("hit", F.lit(True))
    joined = phrases.join(hit, [by, "phrase"], "left").join(containing(phrases, corpus, key).withColumn("there", F.lit(True)), "phrase", "left")
    return joined.select(by, "phrase", F.when(F.col("hit"), "retrieved").when(F.col("there"), "in corpus but missed").otherwise("not in corpus").alias("status"))
