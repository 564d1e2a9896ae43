"""The corpus pipeline: stages that each work on what their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
scratch folder and reads it again as the next stage's docs. All stages but the last return the columns
of `documents`, and any further ones. Null and empty texts have no language, so they go in the first stage; very long texts
go through whole; of rows repeated in full one stays from the second stage on; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaskb.llm import exact_dedup, language_id, minhash_dedup, packing, suffix_dedup
from atlaskb.llm.common import Scratch, read

#: Texts whose n-grams are this unlike every language are rejected; texts in a learned language score over 0.4.
MIN_SCORE = 0.2
#: Bytes of a passage that repeats: some fifty words.
PASSAGE = 240


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's labels know; those without a letter or unlike any language go."""
    return language_id.filter_rejects(docs, MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that are equal but for white space."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash_dedup.dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; a document of which nothing is left goes."""
    cut = suffix_dedup.clean(docs, PASSAGE, "first")
    left = cut.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("tokens")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("suffix_dedup", passages),
    ("packing", pack),
]

#: SQL can't express near-duplicate components at these sizes, nor tokens; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
