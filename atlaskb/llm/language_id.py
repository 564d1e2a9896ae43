"""Language identification by rank-order n-gram profiles.

Training counts the letter n-grams of 1 to 3 letters of all training texts by language (words are padded with a
word mark; counts of a batch are added up before they are shuffled) and keeps each language's TOP most
frequent ones with their rank. A document's own most frequent TOP n-grams are ranked likewise; its
distance to a language is the sum, over them, of the difference of ranks, or TOP where the profile lacks the
n-gram. The nearest language wins. An n-gram is held as its code points, 21 bits each, in one integer.

Only the profiles (languages x TOP rows) come to the driver.

Defined results: `und` with score 0 for a null text or one without a letter; equal counts rank by code
points, equal distances by the language's name; a null language is not trained on; without any training
row every text is `und`; a very long text is read whole; empty tables give empty results; further columns are ignored,
whatever their names; repeated rows count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, read

TOP = 400
#: The word mark, and letters of a batch up to which n-grams are counted in a table rather than by sorting.
MARK, ALPHABET = ord("_"), 128


@cache
def _is_letter() -> np.ndarray:
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in regex.findall(r"\p{L}", "".join(map(chr, points)))]] = True
    return table


def marked_letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text: words with one mark before, between and after; empty without a letter."""
    codes = np.frombuffer(f"_{text.lower()}_".encode("utf-32-le"), dtype=np.uint32)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, MARK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    kept = codes[keep].astype(np.int64)
    return kept if len(kept) > 2 or letter.any() else kept[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams, packed; none crosses a word's border."""
    one = codes[codes != MARK]
    two = codes[:-1] << 21 | codes[1:]
    two = two[(codes[:-1] != MARK) | (codes[1:] != MARK)]
    three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != MARK]
    return np.concatenate((one, two, three))


def counted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    packed = np.sort(packed)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    return packed[first], np.diff(np.append(first, len(packed)))


def counted_by_table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as counted(grams(codes)), by a table over the letters that occur."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    if n > ALPHABET:
        return counted(grams(codes))
    place = np.zeros(0x110000, dtype=np.int64)
    place[letters] = np.arange(n)
    c, mark = place[codes], place[MARK]
    one = np.bincount(c, minlength=n)
    one[mark] = 0
    two = np.bincount(c[:-1] * n + c[1:], minlength=n * n)
    two[mark * n + mark] = 0
    three = np.bincount((c[:-2] * n + c[1:-1]) * n + c[2:], minlength=n**3)
    three.reshape(n, n, n)[:, mark, :] = 0
    a, b, t = (np.flatnonzero(x) for x in (one, two, three))
    packed = np.concatenate((letters[a], letters[b // n] << 21 | letters[b % n], letters[t // n // n] << 42 | letters[t // n % n] << 21 | letters[t % n]))
    return packed, np.concatenate((one[a], two[b], three[t]))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(marked_letters(text))
        for lang, parts in by_lang.items():
            # Each part begins and ends with a mark, so nothing crosses from one to the next.
            codes = np.concatenate(parts)
            if len(codes):
                keys, n = counted_by_table(codes)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's n-grams, most frequent first, learned from all rows of docs."""
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = map_batches(source, _count_grams, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in top.select("lang", "key", "rank").collect():
        profiles.setdefault(lang, []).append((rank, gram))
    return {lang: [gram for _, gram in sorted(found)] for lang, found in sorted(profiles.items())}


class Ranker:
    """Predicts with trained profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.known = np.array(sorted({g for found in profiles.values() for g in found}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = marked_letters(text) if text else ()
        if not len(codes) or not self.langs:
            return "und", 0.0
        found, n = counted(grams(codes))
        if len(found) > TOP:
            least = np.partition(n, len(n) - TOP)[len(n) - TOP]
            found, n = found[n >= least], n[n >= least]
        found = found[np.argsort(-n, kind="stable")[:TOP]]
        where = np.searchsorted(self.known, found)
        where[where == len(self.known)] = 0
        where = np.where(self.known[where] == found, where, len(self.known))
        ranks = self.ranks[:, where]
        distance = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(found))), TOP), TOP).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (TOP * len(found)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score for every row, and the columns named in keep; only the text is looked at."""
    kept = keep or []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = [ranker(t) for t in batch.column(len(kept) + 1).to_pylist()]
            columns = [*batch.columns[: len(kept) + 1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *kept, "lang_pred", "score"]
    source = docs.select(F.col(id_col).alias("doc_id"), *kept, F.col(text_col).alias("text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_batches(source, rows, f"{kinds}, lang_pred string, score double")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def filter_rejects(docs: DataFrame, min_score: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised: rejected are texts without a
    letter and those whose best score is under min_score (their n-grams are like no language's)."""
    profiles = train(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = [ranker(t) for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return map_batches(docs, rows, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold() == 0)
    profiles = train(docs.where(~F.col("held_out")))
    return predict(docs, profiles, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")
