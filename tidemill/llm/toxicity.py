"""Toxicity: a logistic classifier with a counterfactual penalty.

In labelled sentences that name a group, the name is swapped for another
group's; a change of the margin between both versions is penalised, so that a
neutral mention of a group does not raise the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import BUCKETS, bucket_counts, distinct, held_out, indicators_of, labelled_sample, platt, score_rows
from .shared import table
from .vectors import ALNUM, ngrams, words

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 12000
#: Score from which a row counts as toxic.
THRESHOLD = 0.3
#: Indicators get a weight if their share of toxic rows is this many deviations off the mean share.
LEAST_DEVIATION = 3.0
#: Weight of the counterfactual penalty and of the ridge, step size, passes.
PENALTY, RIDGE, RATE, EPOCHS = 1.0, 1e-5, 0.3, 6

#: Group names that may take each other's place, lower case: English, German, French, Spanish.  Of a name in several groups the first counts.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("taube", "blinde", "behinderte"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("lesbiennes", "bisexuels", "transgenres"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers"),
    ("sourds", "aveugles", "handicapés"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("lesbianas", "bisexuales", "transexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("sordos", "ciegos", "discapacitados"),
)


class Model(NamedTuple):
    """weights of buckets; a, b: calibration of the margin; rows and twins that it was fitted on, without which the penalty has no effect."""

    weights: np.ndarray
    a: float
    b: float
    rows: int
    twins: int


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and word pairs, lower-cased, each once a row."""
    w = words(data, off, ALNUM)
    parts = [ngrams(w, 1, 11), ngrams(w, 2, 12)]
    return distinct([h for h, _ in parts], [r for _, r in parts])


def swapped(text: str | None, groups: tuple = IDENTITY_TERMS) -> str | None:
    """The text with every group name replaced by the next of its list, in the same case; None if it has none."""
    nxt = _successors(groups)
    out, hit, i, low = [], False, 0, (text or "").lower()
    if len(low) != len(text or "") or not any(t in low for t in nxt):
        return None
    n = len(low)
    while i < n:
        j = i
        while j < n and low[j].isalnum():
            j += 1
        if j > i:
            to = nxt.get(low[i:j])
            hit |= to is not None
            out.append(text[i:j] if to is None else to.capitalize() if text[i].isupper() else to)
        else:
            j = i + 1
            out.append(text[i:j])
        i = j
    return "".join(out) if hit else None


_next: dict[tuple, dict[str, str]] = {}


def _successors(groups: tuple) -> dict[str, str]:
    if groups not in _next:
        _next[groups] = {t: g[(i + 1) % len(g)] for g in reversed(groups) for i, t in enumerate(g)}
    return _next[groups]


def counterfactuals(sample: DataFrame, groups: tuple = IDENTITY_TERMS) -> DataFrame:
    """Rows of a sample (id, y, text) that name a group, with the names swapped."""

    def swap(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            new = [swapped(t, groups) for t in b.column(2).to_pylist()]
            keep = pa.array([t is not None for t in new])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], ["id", "y", "text"]).filter(keep)

    return sample.select("id", "y", "text").mapInArrow(swap, sample.schema)


def telling(y: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each bucket, whether it tells the classes apart in the rows that fit the weights."""
    use = np.arange(len(y)) % 5 != 4
    mean = (y[use] == 1).mean()
    n = bucket_counts(x, at, use)
    toxic = bucket_counts(x, at, use & (y == 1))
    return np.abs(toxic - n * mean) >= LEAST_DEVIATION * np.sqrt(n * mean * (1 - mean) + 1)


def fit(y, at, x, twin_of: np.ndarray, twin_at, twin_x, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, float, float]:
    """(weights, a, b): log loss by adaptive gradient steps; row twin_of[k] has the k-th counterfactual.

    Four of five rows fit the weights, the fifth the calibration.  Without
    rows of both classes all scores are the smoothed share of the class.
    """
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS), 1.0, float(np.log(((y == 1).sum() + 1) / ((y != 1).sum() + 1)))
    common = telling(y, at, x)
    twin = {int(i): k for k, i in enumerate(twin_of)}
    train = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    rare = len(train) / (2 * max(1, (y[train] == 1).sum()))
    weight = np.where(y == 1, min(rare, 5.0), 1.0)
    w, g2, bias, b2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(seed)
    rows = [r[common[r]] for r in (x[at[i] : at[i + 1]] for i in range(len(y)))]
    twins = [r[common[r]] for r in (twin_x[twin_at[k] : twin_at[k + 1]] for k in range(len(twin_of)))]

    def step(idx: np.ndarray, g: float) -> None:
        grad = g + RIDGE * w[idx]
        g2[idx] += grad * grad
        w[idx] -= RATE * grad / np.sqrt(g2[idx])

    for _ in range(epochs):
        for i in rng.permutation(train):
            r = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[r].sum() + bias, -30, 30)))
            g = (p - y[i]) * weight[i]
            step(r, g)
            b2 += g * g
            bias -= RATE * g / np.sqrt(b2)
            if (k := twin.get(int(i))) is not None:
                here, there = np.setdiff1d(r, twins[k]), np.setdiff1d(twins[k], r)
                d = penalty * (w[here].sum() - w[there].sum())
                step(here, d)
                step(there, -d)
    margin = np.array([w[r].sum() for r in rows]) + bias
    held = np.setdiff1d(np.arange(len(y)), train)
    a, b = platt(margin[held], y[held])
    return w, a, a * bias + b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS, groups: tuple = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """A model from at most ``most`` ids of ``labels`` and SAMPLE_BYTES of their texts, as ``labelled_sample`` has them, and their counterfactuals.

    ``groups``: the names that are swapped; the model tells how many texts had any.
    """
    sample = labelled_sample(docs, labels, label, most)
    y, at, x = indicators_of(sample, indicators)
    swaps = counterfactuals(sample, groups)
    ids = [sample.select("id").toArrow().column(0), swaps.select("id").toArrow().column(0)]  # an id has one row
    place = {k: i for i, k in enumerate(sorted(ids[0].to_pylist()))}
    of = np.array([place[k] for k in sorted(ids[1].to_pylist())], np.int64)
    _, t_at, t_x = indicators_of(swaps, indicators)
    return Model(*fit(y, at, x, of, t_at, t_x, penalty), len(y), len(of))


def score_toxicity(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score, 0 to 1.

    Null and empty texts get the score of the intercept; equal texts get equal
    scores; an empty table stays empty; a column named score is replaced.
    """
    return score_rows(docs, model[:3], indicators, False, text_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``score_toxicity`` gives them; three quarters of the labels by id's hash are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2))
    out = score_toxicity(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
