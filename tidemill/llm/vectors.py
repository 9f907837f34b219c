"""Words of Arrow text columns as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are handled at once; a longer text is cut at a word's end.
BLOCK_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(32)
    return h


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the 256 bytes: True for those that are part of a word."""
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Words as runs of anything but white space, and as runs of letters, digits aside.
NOT_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
LETTERS = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))

_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(max(n, min(2 * len(_powers[kind]), BLOCK_BYTES + 1)), _BASE if kind == "up" else _BASE_INVERSE, _U)
        p[0] = 1
        _powers[kind] = np.cumprod(p, out=p)
    return _powers[kind]


@dataclass
class Words:
    """Words in order: hash, row, and place in the bytes ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair; equal bytes have equal hashes."""
    up, down = _power("up", len(data) + 1), _power("down", len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hash`` of spans in order, in pieces of about BLOCK_BYTES cut between spans."""
    hashes = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, "right")))
        a, b = start[i], end[j - 1]
        hashes[i:j] = span_hash(data[a:b], start[i:j] - a, end[i:j] - a)
        i = j
    return hashes


def words(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> Words:
    """Words of the rows, hashed after each byte is mapped by ``fold``."""
    data = fold[data]
    inside = part[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(hash_spans(data, start, end), row, start, end, data)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        _, off = texts(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ngrams(w: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and their rows."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.full(m, _U(salt * 2 + 1))
    for i in range(n):
        h = mix(h * _U(0x9FB21C651E98DF25) + w.hash[i : i + m])
    same = w.row[:m] == w.row[n - 1 :]
    return h[same], w.row[:m][same]


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n).astype(np.float64)
