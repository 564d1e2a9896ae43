"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Documents are dealt into RUNS runs by a hash of their id. A run is a table sorted by digest with one entry for each,
which retains the best document (most code points, then smallest id) and the row count; Spark combines on the map
side first. Runs then meet in binomial rounds: in round k, run r takes in run r + 2**k, for all r that are multiples of
2**(k+1) at once, by a sort-merge full outer join that walks the two sorted runs together, and retains the better entry of a
digest that both have. After log2(RUNS) rounds one run is left. A run is as many partitions as its size asks for (run and
digest are the shuffle key), so that no round gathers one in a task.
Entries merge only if, beside the SHA-256 digest, the normalised length and an independent 64-bit checksum
agree (the verification). On the way back the decision goes down the tree: the final entries join the first
level's entries (at most RUNS for a digest, whatever its number of rows), and those join the rows on
(run, digest), so that a group with a third of all rows is spread over RUNS keys.

Defined results: a null text counts as empty, and empty texts are equal to each other; very long texts are digested whole;
among texts of the same length the smallest id stays, a null id last; of rows repeated in full, one is kept; an empty table gives
an empty result; further columns of the input, whatever their names, are ignored by `mark` and carried by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read

#: Runs at the leaves of the tree, a power of two.
RUNS = 64

_KEY = ["digest", "norm_chars", "checksum"]


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(RUNS)).cast("int").alias("run"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
        F.length(norm).alias("norm_chars"),
        F.xxhash64(norm).alias("checksum"),
        F.length(text).alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )


def merge_runs(level: DataFrame, step: int) -> DataFrame:
    """One round: each run whose number has the bit `step` clear takes in its partner, the run `step` further on."""
    has = F.col("run").bitwiseAND(step) != 0
    partner = level.where(has).select((F.col("run") - step).alias("run"), *_KEY, F.col("best").alias("best_"), F.col("rows").alias("rows_"))
    met = level.where(~has).join(partner.hint("merge"), ["run", *_KEY], "full_outer")
    zero = F.lit(0).cast("long")
    return met.select("run", *_KEY, F.least("best", "best_").alias("best"), (F.coalesce("rows", zero) + F.coalesce("rows_", zero)).alias("rows"))


def _mark(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    rows = scratch.put(_digests(docs, id_col, text_col), "digests")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    leaves = rows.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("rows"))
    leaves = level = scratch.put(leaves.sortWithinPartitions("run", *_KEY), "runs")
    step = 1
    while step < RUNS:
        merged = scratch.put(merge_runs(level, step), "merged")
        if level is not leaves:
            scratch.drop(level)
        level, step = merged, step * 2
    final = level.where("rows > 1").select(*_KEY, "best", F.col("rows").alias("group_size"))
    down = leaves.drop("best", "rows").join(final, _KEY)
    found = rows.join(down, ["run", *_KEY], "left")
    copied = F.col("best").isNotNull()
    return found.select(
        "doc_id",
        F.when(copied, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.when(copied, F.col("best.row") == F.col("row")).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    return scratch.end(_mark(docs, id_col, text_col, scratch))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    mine, theirs = fresh(docs, "digest_"), fresh(docs, "dropped_")
    dropped = scratch.end(_mark(docs, id_col, text_col, scratch).where("NOT kept").select("doc_id", "keep_id", "text_sha256"))
    keyed = docs.withColumn(mine, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    if not dropped.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        # Rows repeated in full (or under one id): the longest of an id and digest stays, once.
        n = fresh(keyed, "n_chars_")
        keyed = keyed.withColumn(n, -F.length(F.coalesce(F.col(text_col), F.lit(""))))
        one = keyed.groupBy(F.col(id_col).alias("a"), F.col(mine).alias("b")).agg(F.min_by(F.struct(*keyed.columns), F.col(n)).alias("r"))
        keyed = one.select("r.*").drop(n)
    others = dropped.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(theirs), F.col("text_sha256").alias(f"{theirs}sha"))
    same = F.col(id_col).eqNullSafe(F.col(theirs)) & (F.col(mine) == F.col(f"{theirs}sha"))
    return keyed.join(others, same, "left_anti").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

