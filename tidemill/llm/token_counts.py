"""Token counts: a linear longest-match automaton.

A trie of the vocabulary gets a failure link for each node and the number of
pieces that following the link pops.  Running a word through it gives the
length of its greedy longest-match segmentation in time linear in the word,
without building a piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import hide, shown, table
from .vectors import NOT_SPACE, SAME, Words, blocks, column, texts, words

NONE = -1


@dataclass
class Automaton:
    """Trie edges as sorted (node * 256 + byte) keys, failure links, and pieces popped by each."""

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    def go(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * 256 + byte
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.to[i], NONE)


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary; empty pieces are passed over."""
    edges: dict[int, int] = {}
    depth, parent, byte, is_piece = [0], [NONE], [0], [False]
    for piece in pieces:
        node = 0
        for c in piece:
            key = node * 256 + c
            nxt = edges.get(key)
            if nxt is None:
                nxt = edges[key] = len(depth)
                depth.append(depth[node] + 1)
                parent.append(node)
                byte.append(c)
                is_piece.append(False)
            node = nxt
        is_piece[node] = node != 0
    fail, pops = [NONE] * len(depth), [0] * len(depth)
    for v in sorted(range(1, len(depth)), key=depth.__getitem__):
        if is_piece[v]:
            fail[v], pops[v] = 0, 1
            continue
        z, n = fail[parent[v]], pops[parent[v]]
        while z != NONE and (nxt := edges.get(z * 256 + byte[v])) is None:
            n += pops[z]
            z = fail[z]
        if z != NONE:
            fail[v], pops[v] = nxt, n
    keys = np.array(sorted(edges), np.int64) if edges else np.array([-1], np.int64)
    to = np.array([edges.get(int(k), 0) for k in keys], np.int64)
    return Automaton(keys, to, np.array(fail, np.int64), np.array(pops, np.int64))


def lengths(a: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: bytes) -> np.ndarray:
    """Pieces of each ``lead`` + data[start:end]; a word that the vocabulary cannot spell is one unknown piece.

    All words step together, longest first, a byte at a time.
    """
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    node, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    unknown = np.zeros(len(start), bool)

    def step(k: int, c: np.ndarray) -> None:
        live = np.flatnonzero(~unknown[:k])
        while len(live):
            nxt = a.go(node[live], c[live])
            ok = nxt != NONE
            node[live[ok]] = nxt[ok]
            live = live[~ok]
            count[live] += a.pops[node[live]]
            node[live] = a.fail[node[live]]
            lost = node[live] == NONE
            unknown[live[lost]] = True
            live = live[~lost]

    for c in lead:
        step(len(start), np.full(len(start), c))
    for s in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -s, "left"))
        step(k, data[start[:k] + s])
    live = np.flatnonzero(~unknown & (node != 0))
    while len(live):
        count[live] += a.pops[node[live]]
        node[live] = a.fail[node[live]]
        lost = node[live] == NONE
        unknown[live[lost]] = True
        live = live[~lost]
        live = live[node[live] != 0]
    out = np.empty(len(count), np.int64)
    out[order] = np.where(unknown, 1, count)
    return out


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks; None is the byte-level vocabulary that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def count_tokens(docs: DataFrame, pieces: list[bytes], text_col: str = "text", lead: bytes = b" ") -> DataFrame:
    """All columns of ``docs`` plus n_words and n_tokens.

    Words are runs of anything but white space; each is ``lead`` and the word,
    cut greedily into the longest pieces.  Null, empty and blank texts have 0
    words and tokens; equal texts get equal counts; an empty table stays
    empty; columns of those names are replaced.
    """
    rows, hidden, (text_col,) = hide(docs, ("n_words", "n_tokens"), text_col)
    names = list(hidden)
    shared = docs.sparkSession.sparkContext.broadcast(build(pieces))  # grows with the vocabulary only

    def count(batches: Iterator[pa.RecordBatch]):
        a = shared.value
        for batch in blocks(batches, text_col):
            w: Words = words(*texts(column(batch, text_col)), NOT_SPACE, SAME)
            _, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
            each = lengths(a, w.data, w.start[first], w.end[first], lead)[place]
            n = batch.num_rows
            tokens = np.bincount(w.row, weights=each, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(np.bincount(w.row, minlength=n).astype(np.int64)), pa.array(tokens)], [*names, "n_words", "n_tokens"])

    schema = rows.select(*names).schema.add("n_words", "long").add("n_tokens", "long")
    return rows.mapInArrow(count, schema).select(*shown(hidden), "n_words", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``count_tokens`` gives them for the byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary()).select("doc_id", "n_words", "n_tokens")


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
