"""Quality classifier: naive Bayes support vectors.

Indicators of word and word-shape n-grams are scaled by the log-count ratio of
the classes, and a linear hinge-loss model is fitted on them by dual
coordinate descent.  The margin is calibrated on rows that the fit left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import BUCKETS, bucket_counts, distinct, held_out, indicators_of, labelled_sample, platt, row_margins, score_rows
from .shared import table
from .vectors import NOT_SPACE, SAME, Words, mix, ngrams, words

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 8000
#: Score from which a row counts as good.
THRESHOLD = 0.3
#: Smoothing of counts, mixing of weights with their mean, the hinge loss's cost, passes.
ALPHA, BETA, COST, EPOCHS = 1.0, 0.25, 1.0, 12

_KIND = np.zeros(256, np.uint64)  # of a byte: 0 other sign, 1 lower, 2 upper, 3 digit, 4 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def shapes(w: Words) -> Words:
    """The words with a hash of their shape: kinds of the first two and last two bytes, a closing sign, length, sameness with the word before."""
    last = w.end - 1
    code = _KIND[w.data[w.start]]
    for at in (np.minimum(w.start + 1, last), np.maximum(last - 1, w.start), last):
        code = code * np.uint64(5) + _KIND[w.data[at]]
    sign = np.where(_KIND[w.data[last]] == 0, w.data[last], 0).astype(np.uint64)
    size = np.minimum(np.log2(w.end - w.start).astype(np.uint64), np.uint64(5))
    same = np.zeros(len(w.hash), np.uint64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    return Words(mix(((code * np.uint64(256) + sign) * np.uint64(8) + size) * np.uint64(2) + same), w.row, w.start, w.end, w.data)


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(data, off, NOT_SPACE, SAME)
    s = shapes(w)
    parts = [ngrams(w, 1, 1), ngrams(w, 2, 2), ngrams(s, 1, 3), ngrams(s, 2, 4), ngrams(s, 3, 5)]
    return distinct([h for h, _ in parts], [r for _, r in parts])


def log_count_ratio(y: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = ALPHA + bucket_counts(x, at, y == 1)
    q = ALPHA + bucket_counts(x, at, y != 1)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(y: np.ndarray, at: np.ndarray, x: np.ndarray, value: np.ndarray, use: np.ndarray | None = None, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of a linear model with hinge loss, fitted on the rows ``use``; each dual variable is brought to its optimum in turn.

    Rows weigh in inverse proportion to their class's share.
    """
    use = np.arange(len(y)) if use is None else use
    own = y[use]
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * len(own) / (2 * np.where(y == 1, max(1, (own == 1).sum()), max(1, (own != 1).sum())))
    w, dual = np.zeros(BUCKETS), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    norm = np.array([max(float(value[a:b] @ value[a:b]), 1e-9) for a, b in zip(at[:-1], at[1:], strict=True)])
    for _ in range(epochs):
        for i in rng.permutation(use):
            s = slice(at[i], at[i + 1])
            xi, vi = x[s], value[s]
            new = min(max(dual[i] - (sign[i] * (w[xi] @ vi) - 1) / norm[i], 0.0), upper[i])
            if new != dual[i]:
                w[xi] += (new - dual[i]) * sign[i] * vi
                dual[i] = new
    return w


def fit(y: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, a, b); four of five rows fit the weights, the fifth the calibration.

    Without rows of both classes all scores are the smoothed share of the class.
    """
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS), 1.0, float(np.log(((y == 1).sum() + 1) / ((y != 1).sum() + 1)))
    r = log_count_ratio(y, at, x)
    value = r.astype(np.float32)[x]
    for i in range(len(y)):
        value[at[i] : at[i + 1]] /= np.sqrt(max(1, at[i + 1] - at[i]))
    apart = np.arange(len(y)) % 5 == 4
    w = dual_coordinate_descent(y, at, x, value, np.flatnonzero(~apart))
    used = np.abs(w)[w != 0]
    w = (1 - BETA) * (used.mean() if len(used) else 0.0) * (w != 0) + BETA * w
    margin = row_margins(w, x, at, value)
    return (w * r, *platt(margin[apart], y[apart]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float]:
    """A model from at most ``most`` ids of ``labels`` and SAMPLE_BYTES of their texts, as ``labelled_sample`` has them."""
    return fit(*indicators_of(labelled_sample(docs, labels, label, most), indicators))


def score_quality(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score, 0 to 1.

    Null and empty texts have no indicators and get the score of the
    intercept; equal texts get equal scores; an empty table stays empty; a
    column named score is replaced.
    """
    return score_rows(docs, model, indicators, True, text_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``score_quality`` gives them; four fifths of the labels by id's hash are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    out = score_quality(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
