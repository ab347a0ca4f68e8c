"""Quality scores from pairwise preferences (Bradley-Terry).

A document's strength is linear in features of its text. Pairs of a good and
a bad labelled document say that the first is preferred; the weights minimise
the logistic loss on the difference of their features. The threshold is the
quantile of the training documents' strengths that tells their labels apart
best, and the score is the logistic function of strength less threshold.

The weights are learned from a bounded sample of labelled rows: the PER_LABEL
documents of each label whose id hashes lowest, PAIRS partners for each of the
rarer label. Everything else covers all rows. No column but text is a feature.

Edge cases: null and empty texts are scored like any other, by features that
are all zero but for shortness; a very long text is one slice, in memory at
once; an empty table gives no rows; labels that are null or contradict one another
are not learned from; without labelled pairs every score is 0.5, which
predicts 1; of rows that share an id the least text is learned from; repeated
rows score alike; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted
from .textstats import counts, packed_sizes, slices

PER_LABEL, PAIRS, RIDGE, QUANTILES = 10_000, 24, 1e-3, 1001
FEATURES = ("log_words", "symbols", "odd", "upper", "digits", "high", "word_length", "adjacent", "distinct", "repeats", "dup_lines", "ratio", "short")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    c = counts(texts)
    whole, _, _ = packed_sizes(texts)
    n, chars, words = (np.maximum(1, c[k]) for k in ("n_words", "n_chars", "word_chars"))
    share = lambda k, of: np.sqrt(c[k] / of)  # noqa: E731  roots spread small shares out
    expected = 0.9 + 0.16 * np.log(np.maximum(1, c["n_bytes"] / 64))  # how prose of this length compresses, roughly
    return np.column_stack(
        [
            np.log(n), share("n_symbols", chars), share("odd", chars), share("upper", np.maximum(1, c["letters"])), share("digits", chars), share("high", chars),
            np.log(words / n), share("n_adjacent", n), np.log(np.maximum(1, c["n_distinct"])) / np.log(n + 1), share("n_repeat_words", n), share("n_dup_lines", np.maximum(1, c["n_lines"])),
            np.log(np.maximum(0.1, c["n_bytes"] / whole)) - np.log(expected), np.exp(-n / 20.0),
        ]
    )


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(features(texts)) - self.threshold, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Newton steps on the pairs' logistic loss; rows of x in a fixed order give the same model every time."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / spread, -8, 8)
    rng, few = np.random.default_rng(seed), min(len(up), len(down))
    a = np.tile(up, -(-few * pairs // len(up)))[: few * pairs]
    b = np.tile(down, -(-few * pairs // len(down)))[: few * pairs]
    diff, w = z[rng.permutation(a)] - z[rng.permutation(b)], np.zeros(d)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = -diff.T @ (1 - p) / len(diff) + ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(d), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    # each label counts as much as it does in the sample; of equally good quantiles the middle one
    cut = np.quantile(s, np.linspace(0, 1, QUANTILES))
    right = np.array([np.mean(good == (s >= t)) for t in cut])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return Model(centre, spread, w, float(cut[best[len(best) // 2]]))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        x = features(texts)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, use=None, per_label: int = PER_LABEL) -> Model:
    """The model from the labelled documents for which use (a condition on doc_id) holds."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    one = one.where(use) if use is not None else one
    one = one.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q", F.xxhash64("doc_id").alias("h"))
    sample = one.where("q = 0").orderBy("h", "doc_id").limit(per_label).unionAll(one.where("q = 1").orderBy("h", "doc_id").limit(per_label))
    good = sample.select("doc_id", (F.col("q") == 1).alias("good"))  # 2 * per_label rows at most, so it can be broadcast
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(good), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))  # an id's rows count once, so that the bound holds
    rows = got.mapInArrow(_features_of, "doc_id long, good boolean, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y, ids = rows["good"].to_numpy(zero_copy_only=False).astype(bool), rows["doc_id"].to_numpy()
    order = np.lexsort((*x.T, ids)) if len(ids) else np.zeros(0, int)
    return fit(x[order], y[order])


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(texts))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of 0.5 or more, with all their columns, in one pass without a shuffle."""

    at = f"c{docs.columns.index('text')}"  # by place, as a column of docs may have any name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, at):
            yield rows.filter(pa.array(model.score(texts) >= 0.5)).rename_columns(names)

    names = docs.columns
    return docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)]).mapInArrow(run, docs.schema)


#: The condition under which a label may be learned from; the other third is held out.
LEARNED = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"


def op9_pairwise(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scores(docs, train(docs, labels, LEARNED)).select("doc_id", F.expr(f"not ({LEARNED})").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
