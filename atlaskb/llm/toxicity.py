"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model: for ordered grades 0 < 1 < ... < K, P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector w
for all thresholds. x counts, over the distinct words of a text, the word and its first PREFIXES letters (so
that forms of a word that training didn't meet are known by their stem). The result is the expected grade,
sum of k * P(grade = k), and `toxic`, whether P(grade >= 1) is at least one half.

The labels of the corpus are 0 or 1, so the grades of the toxic ones are told apart by how much of the
text speaks for it: features that are WEIGHT times as frequent in toxic as in other training documents are
marked, and toxic documents whose marked features are more than the median of all toxic ones get grade 2,
the others 1. A table that has a column of grades is trained on as it is (`fit`).

The training set is bounded: the SAMPLE labelled documents with the smallest hash of their id. That is the only
bounded part; every document is scored, on its whole text.

Defined results: a null or empty text has no features and gets the expected grade of the thresholds alone, and
isn't toxic; labels that are null are left out; without labels of both kinds no document is toxic and the
grade is 0; several labels of one id count each; repeated rows are scored each; a very long text counts as the set of its
words; empty tables give empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

#: Labelled documents that the model is fitted on at most.
SAMPLE = 8_000
PREFIXES = (4, 5)
WEIGHT, LEAST = 8.0, 3
#: Standard errors by which a feature's frequencies in toxic and other documents must differ to be used.
EVIDENCE = 4.0
MEMO = 300_000
_WORDS = regex.compile(r"[\p{L}\p{N}']+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    """64-bit hashes of a word's features."""
    parts = [word, *(f"{word[:n]}\t" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(p) for p in parts]


class Ordinal:
    """Ascending features, their weights, and ascending thresholds (number of grades less one)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def at_least(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


class Scorer:
    """A text's score, with a bounded memo of the sum of a word's weights."""

    def __init__(self, model: Ordinal):
        self.weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
        self.memo: dict[str, float] = {}

    def __call__(self, text: str | None) -> float:
        memo, weight, total = self.memo, self.weight, 0.0
        for word in sorted(words_of(text)):
            found = memo.get(word)
            if found is None:
                if len(memo) > MEMO:
                    memo.clear()
                found = memo[word] = sum(weight.get(f, 0.0) for f in features_of(word))
            total += found
        return total


def fit(flat: np.ndarray, owner: np.ndarray, grades: np.ndarray, steps: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> Ordinal:
    """Fit by full-gradient AdaGrad on the likelihood with a ridge on the weights. flat holds the features of all
    rows and owner their rows; features that are too rare or that tell too
    little aren't used. Thresholds are kept in
    order as the first and the logarithms of the gaps."""
    n, k = len(grades), int(grades.max(initial=0))
    if k == 0 or grades.min() == k:
        return Ordinal(flat[:0], np.zeros(0), np.full(max(k, 1), 60.0))
    places, flat, times = np.unique(flat, return_inverse=True, return_counts=True)
    # Only features that tell grades above 0 from grade 0 beyond chance; the many rare words would be learned by heart.
    n_bad = int((grades > 0).sum())
    bad = np.bincount(flat[(grades > 0)[owner]], minlength=len(places))
    mean = times / n
    z = (bad / n_bad - (times - bad) / (n - n_bad)) / np.sqrt(np.maximum(mean * np.maximum(1 - mean, 1 / n), 1e-12) * (1 / n_bad + 1 / (n - n_bad)))
    often = (times >= LEAST) & (np.abs(z) >= EVIDENCE)
    number = np.cumsum(often) - 1
    kept = often[flat]
    places, flat, owner = places[often], number[flat[kept]], owner[kept]
    share = np.array([(grades >= j).mean() for j in range(1, k + 1)])
    start = np.log((1 - share) / np.maximum(share, 1e-6))
    theta = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    weights, past_w, past_t = np.zeros(len(places)), np.full(len(places), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        score = np.bincount(owner, weights=weights[flat], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(np.concatenate((cuts, [np.inf]))[grades] - score, -60, 60)))
        under = 1 / (1 + np.exp(-np.clip(np.concatenate(([-np.inf], cuts))[grades] - score, -60, 60)))
        below, under = np.where(grades == k, 1.0, below), np.where(grades == 0, 0.0, under)
        p = np.maximum(below - under, 1e-9)
        d_below, d_under = below * (1 - below) / p, under * (1 - under) / p
        g_w = np.bincount(flat, weights=((d_below - d_under) / n)[owner], minlength=len(places)) + ridge * weights
        g_cut = np.zeros(k)
        np.add.at(g_cut, grades[grades < k], -d_below[grades < k] / n)
        np.add.at(g_cut, grades[grades > 0] - 1, d_under[grades > 0] / n)
        g_t = np.cumsum(g_cut[::-1])[::-1] * np.concatenate(([1.0], np.exp(theta[1:])))
        past_w += g_w * g_w
        past_t += g_t * g_t
        weights -= rate * g_w / np.sqrt(past_w)
        theta -= rate * g_t / np.sqrt(past_t)
    return Ordinal(places, weights, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))))


def grades_of(flat: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1, as the module's text says."""
    if not toxic.any():
        return toxic
    flat = np.unique(flat, return_inverse=True)[1]
    of_toxic = toxic[owner] == 1
    size = int(flat.max(initial=0)) + 1
    bad, good = np.bincount(flat[of_toxic], minlength=size), np.bincount(flat[~of_toxic], minlength=size)
    n_bad, n_good = toxic.sum(), max(int((1 - toxic).sum()), 1)
    marked = (bad >= LEAST) & (bad / n_bad >= WEIGHT * (good + 0.5) / n_good)
    counts = np.bincount(owner, weights=marked[flat], minlength=len(toxic))
    return np.where(toxic == 0, 0, np.where(counts > np.median(counts[toxic == 1]), 2, 1))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array([f for w in words_of(t) for f in features_of(w)], dtype=np.uint64).view(np.int64) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.int64()))], ["toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    marked = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("toxic")).where("toxic IS NOT NULL AND id_ IS NOT NULL")
    marked = marked.orderBy(F.xxhash64("id_"), "id_", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id_").select("toxic", "text")
    found = map_batches(texts, _featurize, "toxic int, features array<long>").toArrow()
    toxic = found["toxic"].to_numpy().astype(np.int64)
    lists = found["features"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat = lists.flatten().to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    return fit(flat, owner, grades_of(flat, owner, toxic))


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, probability (of grade 1 or more), expected_grade and toxic for every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [model.at_least(scorer(t)) for t in batch["text"].to_pylist()]
            filled = [bool(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([float(p[0]) for p in found]), pa.array([float(p.sum()) for p in found]), pa.array([f and bool(p[0] >= 0.5) for f, p in zip(filled, found, strict=True)])],
                schema=pa.schema([("doc_id", batch["doc_id"].type), ("probability", pa.float64()), ("expected_grade", pa.float64()), ("toxic", pa.bool_())]),
            )

    return map_batches(source, rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, probability double, expected_grade double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
