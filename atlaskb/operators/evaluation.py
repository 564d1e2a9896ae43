"""Evaluation of retrieval and answers against cases (question, expected_keywords, min_chunks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_hits(answer: Column, keywords: Column) -> Column:
    low = F.lower(answer)
    return F.filter(keywords, lambda k: F.contains(low, k))


def keyword_score(answer: Column, keywords: Column) -> Column:
    """The share of the keywords that the answer contains; 1 without keywords."""
    return F.when(F.size(keywords) > 0, F.size(keyword_hits(answer, keywords)) / F.size(keywords)).otherwise(1.0)


def results(cases: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Cases (query_id, ...) with the distinct sources found and retrieval_ok; with answers (query_id, answer,
    elapsed_ms) also the keywords met, their score, passed and a preview."""
    found = hits.groupBy("query_id").agg(F.count_distinct("source").alias("chunks"))
    out = cases.join(found, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    out = out.withColumn("retrieval_ok", F.col("chunks") >= F.col("min_chunks"))
    if answers is None:
        return out
    answer, keywords = F.coalesce("answer", F.lit("")), F.col("expected_keywords")
    out = out.join(answers, "query_id", "left").withColumn("keywords_hit", keyword_hits(answer, keywords)).withColumn("keyword_score", keyword_score(answer, keywords))
    return out.withColumn("passed", F.col("retrieval_ok") & (F.col("keyword_score") >= 0.5)).withColumn("answer_preview", F.substring(answer, 1, 120)).drop("answer")


def summary(results: DataFrame) -> DataFrame:
    more = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("keyword_score", "elapsed_ms") if c in results.columns]
    return results.agg(F.count_if("retrieval_ok").alias("retrieval_ok"), F.count(F.lit(1)).alias("cases"), *more)
