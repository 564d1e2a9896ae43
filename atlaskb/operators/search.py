"""Retrieval kernels for batches of queries: BM25, cosine and their weighted reciprocal-rank fusion.

Everything is keyed by query_id, so one job answers the batch. Ties rank by chunk id; scores are rounded before
ranking so that the order of summation can't decide. BM25 reads an Index: postings, terms and corpus figures, which
are made once when chunks are stored (save_index) and of which a batch reads only the buckets of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import tokens
from ..functions.vectors import dot, norm

#: Decimals of cosines and fused ranks, and of BM25 scores, which are larger.
DIGITS, BM25_DIGITS = 9, 6
#: Folders of postings by a hash of the term; vectors of a batch that meet the store at once.
BUCKETS, VECTORS = 64, 1000


@dataclass(frozen=True)
class Index:
    """postings (bucket, term, chunk_id, tf, dl), terms (bucket, term, df) and one row of figures (n_docs, avgdl, mean_raw)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens, dl)"""
    return chunks.select("chunk_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def term_stats(tok: DataFrame) -> DataFrame:
    """(term, df): partial counts are combined before the shuffle."""
    return tok.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tok: DataFrame) -> DataFrame:
    return tok.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _raw() -> Column:
    return F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def build_index(chunks: DataFrame) -> Index:
    tok = tokenized(chunks)
    postings = tok.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms, sizes = term_stats(tok), corpus_stats(tok)
    mean = terms.crossJoin(F.broadcast(sizes.select("n_docs"))).agg(F.avg(_raw()).alias("mean_raw"))
    return Index(postings.withColumn("bucket", _bucket()), terms.withColumn("bucket", _bucket()), sizes.crossJoin(F.broadcast(mean)))


def save_index(index: Index, root: str) -> None:
    """Write an index: postings and terms in a folder a bucket, sorted by term, so that readers skip what they don't ask for."""
    for name, table in (("postings", index.postings), ("terms", index.terms)):
        # A bucket may be spread over tasks, as one term may have a third of the postings.
        table.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/{name}")
    index.corpus.write.mode("overwrite").parquet(f"{root}/corpus")


def load_index(spark: SparkSession, root: str) -> Index:
    return Index(*(spark.read.parquet(f"{root}/{name}") for name in ("postings", "terms", "corpus")))


def weighed(terms: DataFrame, corpus: DataFrame, settings: Settings) -> DataFrame:
    """terms (..., df) with their idf: those in more than half of the documents get a share of the mean of all raw values."""
    raw = terms.crossJoin(F.broadcast(corpus.select("n_docs", "mean_raw"))).withColumn("raw", _raw())
    floored = F.when(F.col("raw") < 0, F.col("mean_raw") * settings.epsilon).otherwise(F.col("raw"))
    return raw.withColumn("idf", floored).drop("raw", "n_docs", "mean_raw")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of questions (query_id, question)."""
    return queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(index: Index, queries: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that hold a term of the query."""
    wanted = query_terms(queries).withColumn("bucket", _bucket())
    # The bucket is part of the key, so that folders of buckets that no query asks for are pruned.
    weights = weighed(index.terms.join(wanted, ["bucket", "term"]), index.corpus, settings).drop("df")
    found = index.postings.join(weights, ["bucket", "term"]).crossJoin(F.broadcast(index.corpus.select("avgdl")))
    gain = F.col("qtf") * F.col("idf") * F.col("tf") * (settings.k1 + 1) / (F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("dl") / F.col("avgdl")))
    return found.groupBy("query_id", "chunk_id").agg(F.round(F.sum(gain), BM25_DIGITS).alias("score"))


def cosines(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): every chunk against the batch's vectors, VECTORS of them at a time, which is what a
    nested-loop join sends round."""
    parts = max(1, -(-queries.count() // VECTORS))
    if parts > 1:
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        found = [_cosines(chunks, queries.where(part == i)) for i in range(parts)]
        while len(found) > 1:
            found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2])] + found[len(found) // 2 * 2 :]
        return found[0]
    return _cosines(chunks, queries)


def _cosines(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    n = norm(F.col("vector"))
    asked = queries.select("query_id", F.when(n > 0, F.transform("vector", lambda x: x.cast("double") / n)).otherwise(F.transform("vector", lambda x: x.cast("double"))).alias("vector"))
    m = norm(F.col("embedding"))
    return chunks.select("chunk_id", "embedding", m.alias("m")).crossJoin(asked).select(
        "query_id", "chunk_id", F.round(F.when(F.col("m") > 0, dot(F.col("embedding"), F.col("vector")) / F.col("m")).otherwise(0.0), DIGITS).alias("score")
    )


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with `rank`; Spark cuts each task's part to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int, index: Index | None = None) -> DataFrame:
    """(query_id, chunk_id, rrf, rank, score): the k best by fused rank, with their cosine as score. Each ranking
    contributes its first k * oversample chunks; chunks without a term fill up the BM25 ranking in order of id, if the
    query has any token. Queries may have vector_weight and bm25_weight of their own; else the settings' hold."""
    fetch = k * settings.oversample
    for name in ("vector_weight", "bm25_weight"):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(float(getattr(settings, name))))
    near = cosines(chunks, queries)
    matched = top(bm25(index or build_index(chunks), queries, settings), fetch).select("query_id", "chunk_id", "score")
    # Of the 2 * fetch smallest ids at least fetch are unmatched wherever the ranking has room for one.
    fill = query_terms(queries).select("query_id").distinct().crossJoin(F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(2 * fetch)))
    fill = fill.join(matched, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    worded = top(matched.unionByName(fill), fetch)
    both = top(near, fetch).select("query_id", "chunk_id", "rank", F.lit("vector_weight").alias("by")).unionByName(worded.select("query_id", "chunk_id", "rank", F.lit("bm25_weight").alias("by")))
    weight = F.when(F.col("by") == "vector_weight", F.col("vector_weight")).otherwise(F.col("bm25_weight"))
    fused = both.join(queries.select("query_id", "vector_weight", "bm25_weight"), "query_id").withColumn("part", weight / (settings.rrf_k + F.col("rank")))
    fused = fused.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), DIGITS).alias("rrf"))
    best = top(fused, k, "rrf")
    # The cosine is computed again for the few that are left, rather than kept for all.
    hits = chunks.join(best, "chunk_id").join(queries.select("query_id", "vector"), "query_id")
    n = norm(F.col("embedding")) * norm(F.col("vector"))
    return hits.select("query_id", "chunk_id", "rrf", "rank", F.round(F.when(n > 0, dot(F.col("embedding"), F.col("vector")) / n).otherwise(0.0), DIGITS).alias("score"))
