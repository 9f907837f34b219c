"""What the linear text classifiers share: labelled samples, hashed n-gram indicators, calibration, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, hide, numbered, shown, write_table
from .vectors import blocks, column, row_sums, texts

#: Buckets of the hashed indicators; a model is one float32 for each.
BUCKETS = 1 << 20
#: Most bytes of text in a sample that a model is fitted on.
SAMPLE_BYTES = 64 << 20

#: From (bytes, offsets) of some rows to (bucket, row), each pair once, by row.
Indicators = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct(hashes: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) pairs without repeats, ordered by row."""
    h, r = np.concatenate(hashes), np.concatenate(rows)
    key = np.unique((r.astype(np.int64) << 20) | (h >> np.uint64(44)).astype(np.int64))
    return key & (BUCKETS - 1), key >> 20


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == rest


def bounded(sample: DataFrame, most: int, most_bytes: int, *order: str) -> DataFrame:
    """The rows of ``sample`` (_row, text, at most ``most`` of them) up to ``most_bytes`` of text, in order."""
    size = sample.select(*order, "_row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")).orderBy(*order, "_row").limit(most).toArrow()
    total = np.cumsum(size.column("_size").to_numpy())
    if not len(total) or total[-1] <= most_bytes:
        return sample
    last = max(1, int(np.searchsorted(total, most_bytes, "right")))
    few = sample.sparkSession.createDataFrame([(int(r),) for r in size.column("_row").to_numpy()[:last]], "_row long")
    return sample.join(F.broadcast(few), "_row", "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, y, text) of at most ``most`` labelled ids, a row each, those whose hash is smallest, and of ``most_bytes`` of text; written.

    An id with several labels has the largest; of several rows with an id the
    first in the input's files counts.  Rows with a null id or label are left
    out.  ``docs`` should come from files; it is read once for its ids, once
    for the sample's texts.  The bounds make the broadcasts safe.
    """
    plain, _, (i, t) = hide(docs, (), id_col, text_col)
    rows = numbered(plain)
    known, _, (k, y) = hide(labels, (), id_col, label)
    ids = (
        known.filter(F.col(y).isNotNull() & F.col(k).isNotNull())
        .groupBy(F.col(k).alias("id"))
        .agg(F.max(F.col(y).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    ids = write_table(ids, "labelled")  # at most ``most`` rows
    first = rows.select("_row", F.col(i).alias("id")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("_row").alias("_row"))
    first = write_table(first, "sampled")  # at most ``most`` rows
    sample = write_table(rows.select("_row", F.col(t).alias("text")).join(F.broadcast(first), "_row").select("_row", "id", "y", "text", F.xxhash64("id").alias("_h")), "sample")
    drop_table(ids, first)
    return bounded(sample, most, most_bytes, "_h", "id").select("id", "y", "text")


def indicators_of(sample: DataFrame, of: Indicators) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collect a bounded sample: (y, CSR offsets, buckets), ordered by id so that fits repeat exactly."""

    def features(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            data, off = texts(column(b, "text"))
            idx, row = of(data, off)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(idx, pa.int32()))
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "y"), lists], ["id", "y", "x"])

    t = sample.mapInArrow(features, f"id {sample.schema['id'].dataType.simpleString()}, y int, x array<int>").toArrow().combine_chunks()
    t = t.sort_by([("id", "ascending"), ("y", "ascending")])
    x = t.column("x").combine_chunks()
    size = np.diff(x.offsets.to_numpy())
    return t.column("y").to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(size))), x.flatten().to_numpy()


def bucket_counts(x: np.ndarray, at: np.ndarray, use: np.ndarray) -> np.ndarray:
    """How many of the rows where ``use`` holds have each bucket; a few rows at a time, so that copies stay small."""
    out = np.zeros(BUCKETS)
    for i in range(0, len(use), 256):
        j = min(len(use), i + 256)
        part = x[at[i] : at[j]][np.repeat(use[i:j], np.diff(at[i : j + 1]))]
        out += np.bincount(part, minlength=BUCKETS)
    return out


def row_margins(w: np.ndarray, x: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.array([w[x[a:b]] @ value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits y, by Newton's method with smoothed targets and a >= 0."""
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    if not pos or not neg:
        return 1.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    m = np.column_stack([margin, np.ones(len(margin))])
    ab = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ ab, -30, 30)))
        g = m.T @ (p - t) + 1e-3 * (ab - [1.0, 0.0])
        h = (m * (p * (1 - p) + 1e-6)[:, None]).T @ m + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def score_rows(docs: DataFrame, model: tuple[np.ndarray, float, float], of: Indicators, scaled: bool, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and score: the calibrated sum of the weights of a row's indicators.

    scaled: the sum is divided by the root of their number.
    """
    weights, a, b = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS floats, whatever the input
    rows, hidden, (text_col,) = hide(docs, ("score",), text_col)
    names = list(hidden)

    def score(batches: Iterator[pa.RecordBatch]):
        w = shared.value
        for batch in blocks(batches, text_col):
            data, off = texts(column(batch, text_col))
            idx, row = of(data, off)
            n = batch.num_rows
            margin = row_sums(w[idx], row, n)
            if scaled:
                margin /= np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(p)], [*names, "score"])

    return rows.mapInArrow(score, rows.select(*names).schema.add("score", "double")).select(*shown(hidden), "score")
