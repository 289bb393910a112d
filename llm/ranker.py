"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its whole text. The weights are learned from
preference pairs (a document labelled good is preferred to one labelled bad) by the logistic loss on
the difference of their features. The cut is the quantile, over the scores of all labelled documents, that
leaves the labelled share of bad ones below it; scores are shifted so that the cut lies at `cut_at`.

The features are computed in one narrow pass over all texts and written; only the bounded training
sample (`max_labelled` rows of a few dozen numbers) comes to the driver. The weights alone depend on it.

Edge cases: null and empty texts have all-zero counts and are scored as such; labels that are null or
without a document are left out; a label that is repeated for a document, and documents of one id, count once
(the smallest features); very long texts are one row of numbers like others; with labels of one kind only, or none,
all scores are equal and nothing is rejected; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.quantiles import column_quantiles
from llm.common import hash_sample, landed
from llm.words import Words, mix, word_slices

#: Labelled rows that a fit uses at most, drawn by a hash of their id; and pairs drawn from them.
MAX_LABELLED = 20_000
PAIRS = 200_000
CUT_AT = 0.3

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13),
    "stop": b".,;:", "loud": b"!?", "bar": b"|", "sign": b"#$%&*+=<>^~@\\/_", "quote": b"\"'()[]{}-`", "high": range(128, 256),
}
_KIND = np.zeros(256, np.uint8)
for _n, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _n + 1
FEATURES = [
    "words", *_KINDS, "other", "word_length", "long_words", "bare_words", "distinct_words", "distinct_pairs", "distinct_fives",
    "top_word", "line_words", "short_words",
]


def _distinct(texts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most frequent value occurs."""
    order = np.lexsort((hashes, texts))
    t, h = texts[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    if len(at):
        np.maximum.at(most, t[at], np.diff(np.append(at, len(t))))
    return np.bincount(t[at], minlength=n), most


def features(words: Words, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    kinds = _KIND[words.data]
    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(text_of_byte * 16 + kinds, minlength=16 * n).reshape(n, 16)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    text = np.repeat(np.arange(n), count)
    length = words.ends - words.starts
    alnum = np.concatenate([[0], np.cumsum(np.isin(kinds, (1, 2, 3, 11)))])
    bare = alnum[words.ends] == alnum[words.starts]

    def share(flags):
        return np.bincount(text, weights=flags, minlength=n) / some

    distinct, most = _distinct(text, words.hashes, n)
    columns = [np.log1p(count)]
    columns += [table[:, k + 1] / size for k in range(len(_KINDS))] + [table[:, 0] / size]
    columns += [share(length), share(length > 20), share(bare), distinct / some]
    for k in (2, 5):
        grams = words.grams(k)
        inside = text[: len(grams)] == text[k - 1 :] if len(grams) else np.zeros(0, bool)
        of = text[: len(grams)][inside]
        columns.append(_distinct(of, grams[inside], n)[0] / np.maximum(count - k + 1, 1))
    lines = table[:, 5] + 1
    columns += [most / some, np.log1p(count / lines), share(length < 4)]
    return np.column_stack(columns)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in word_slices(batch.column(1)):
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1).slice(lo, hi - lo)]
            rows = features(words, np.concatenate([[0], np.cumsum(lengths)]))
            lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * len(FEATURES), pa.array(rows.ravel()))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], ["id", "features"])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return landed(rows.mapInArrow(_featured, "id long, features array<double>"), "features")


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(weights * features + shift)."""

    weights: tuple[float, ...]
    shift: float

    def margin(self, column: str = "features") -> Column:
        terms = F.zip_with(F.col(column), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.lit(self.shift)

    def score(self, column: str = "features") -> Column:
        return 1 / (1 + F.exp(-self.margin(column)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of the logistic loss over differences of pairs, by Newton steps."""
    gap = better - worse
    w = np.zeros(gap.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        gradient = gap.T @ p - penalty * w
        curve = (gap * (p * (1 - p))[:, None]).T @ gap + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-6:
            break
    return w


def fit(
    featured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, pairs: int = PAIRS, cut_at: float = CUT_AT, seed: int = 7,
) -> Ranker:
    """Learn from labels 1 and 0; rows to leave out must be left out of `labels`."""
    shift = float(np.log(cut_at / (1 - cut_at)))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    known = given.distinct().join(featured, "id").groupBy("id", "label").agg(F.min("features").alias("features"))
    known = landed(known, "labelled")
    total, bad_rows = known.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    rows = hash_sample(known, max_labelled, total, "id", "label").select("label", "features").collect()
    label = np.array([r.label for r in rows])
    if not (0 < label.sum() < len(label)):
        return Ranker((0.0,) * len(FEATURES), shift + 1.0)
    x = np.array([r.features for r in rows])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    x = (x - middle) / spread
    rnd = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = bradley_terry(x[rnd.choice(good, pairs)], x[rnd.choice(bad, pairs)])
    weights, share = tuple((w / spread).tolist()), bad_rows / total
    raw = known.select(Ranker(weights, 0.0).margin().alias("raw"))
    cut = column_quantiles(raw, {"raw": (share,)})["raw"].quantiles[share]
    return Ranker(weights, float(shift - cut))


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    cut_at: float = CUT_AT, **options,
) -> DataFrame:
    """id and score of every document."""
    featured = text_features(docs, id_col, text_col)
    ranker = fit(featured, labels, id_col, label_col, cut_at=cut_at, **options)
    return featured.select("id", ranker.score().alias("score"))
