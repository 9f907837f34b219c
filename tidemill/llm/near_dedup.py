"""MinHash near-dedup: an inverted join over signature coordinates.

Each document is posted under its (coordinate, value) pairs.  Two documents
that match in at least ``matches`` of the coordinates share one of the rarest
``coordinates - matches + 1`` of either, in any common order of pairs: only
those are posted (the prefix), the frequent rest is probed, not merged (the
skip).  Pairs over the match threshold are checked on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, hide, marked, numbered, shown, table, write_table
from .vectors import NOT_SPACE, blocks, column, mix, ngrams, texts, words

_U = np.uint64
#: Bytes of text whose signatures are made at once (the arrays stay in the cache), length from which a list is dealt out in tiles.
SIGNATURE_BYTES, LIST_ROWS = 1 << 20, 4096
#: Counters of pairs: they order the pairs by rarity, and any order is exact, so they need not grow.
COUNTER_BITS = 18
#: Long lists up to this many are broadcast; more are joined to the postings by a shuffle.
MAX_BROADCAST_LISTS = 200_000
#: Documents and shingles of a cluster that are compared with as many others in one task, columns of a matrix there.
TILE_ROWS, TILE_SHINGLES, MATRIX_COLUMNS = 512, 2 << 20, 4096
#: Most probable loss of a pair that is just as similar as asked for.
MISS = 1e-8


@dataclass(frozen=True)
class Setup:
    """width: words of a shingle; similarity in hundredths: links have 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80
    coordinates: int = 64

    @property
    def matches(self) -> int:
        """The most matches that a pair of this similarity has, but for a chance of MISS."""
        n, p = self.coordinates, self.percent / 100
        tail, t = 0.0, 0
        while t < n:
            tail += math.comb(n, t) * p**t * (1 - p) ** (n - t)
            if tail > MISS:
                return max(1, t)
            t += 1
        return n

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row), by row; fewer words than ``width``, but not none, are one shingle."""
    w = words(data, off, NOT_SPACE)
    n = len(off) - 1
    h, r = ngrams(w, width, 21)
    count = np.bincount(w.row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        for i in short:  # at most width - 1 words each
            v = np.full(1, count[i], _U)
            for x in w.hash[at[i] : at[i + 1]]:
                v = mix(v * _U(0x9FB21C651E98DF25) + x)
            h, r = np.append(h, v), np.append(r, i)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], r[first]


def signatures(h: np.ndarray, row: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """n x coordinates minima of the rows' hashes under as many permutations; rows without any get the largest value."""
    rng = np.random.default_rng(2718281)
    xor, odd = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64), rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * _U(2) + _U(1)
    out = np.full((n, coordinates), np.iinfo(np.uint64).max, _U)
    if len(h):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for j in range(coordinates):
            out[row[at], j] = np.minimum.reduceat(mix_fast(h ^ xor[j], odd[j]), at)
    return out


def mix_fast(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = h * odd
    return h ^ (h >> _U(31))


def sign(rows: DataFrame, s: Setup) -> DataFrame:
    """(id, row, n, s1, s2, sig) of each of ``rows`` (id, row, text), written in the shared folder: set size, set hash, signature bytes."""

    def make(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches, "text", SIGNATURE_BYTES):
            h, r = shingle_sets(*texts(column(b, "text")), s.width)
            n = b.num_rows
            at = np.searchsorted(r, np.arange(n + 1))
            total = [np.concatenate((np.zeros(1, _U), np.cumsum(x))) for x in (h, mix(h + _U(1)))]
            s1, s2 = (mix(c[at[1:]] - c[at[:-1]]).view(np.int64) for c in total)
            sig = signatures(h, r, n, s.coordinates)
            packed = pa.Array.from_buffers(pa.binary(8 * s.coordinates), n, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "row"), pa.array(np.diff(at)), pa.array(s1), pa.array(s2), packed], ["id", "row", "n", "s1", "s2", "sig"])

    return write_table(rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, row long, n long, s1 long, s2 long, sig binary"), "signatures")


def _keys(sig: pa.Array, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of the pairs, four bits of each value packed two to a byte), a row each document."""
    v = np.frombuffer(b"".join(sig.to_pylist()), _U).reshape(-1, coordinates)
    low = (v & _U(15)).astype(np.uint8)
    return mix(v + np.arange(coordinates, dtype=_U) * _U(0x9E3779B97F4A7C15)), low[:, 0::2] << 4 | low[:, 1::2]


def _counter(key: np.ndarray) -> np.ndarray:
    return (key >> _U(64 - COUNTER_BITS)).astype(np.int64)


def pair_counts(signed: DataFrame, s: Setup) -> np.ndarray:
    """How many pairs fall on each counter: a size that does not depend on the input."""
    counters = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(counters, np.int64)
        for b in batches:
            if b.num_rows:
                k, _ = _keys(b.column(0), s.coordinates)
                total += np.bincount(_counter(k).ravel(), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["k", "n"])

    t = signed.select("sig").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int64)
    out[t.column("k").to_numpy()] = t.column("n").to_numpy()
    return out


def _prefix(sig: pa.Array, counts: np.ndarray, s: Setup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document the keys of its rarest pairs, their counters' totals, and the four-bit values."""
    k, low = _keys(sig, s.coordinates)
    n = counts[_counter(k)]
    order = np.lexsort((k, n), axis=1)[:, : s.prefix]
    return np.take_along_axis(k, order, 1), np.take_along_axis(n, order, 1), low


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def long_lists(reps: DataFrame, s: Setup, counts: np.ndarray) -> DataFrame:
    """(key, p), written: the keys of lists over LIST_ROWS and the number of parts that each is dealt out in.

    Lengths are counted, so a list is cut only if it is long.  Only keys whose
    counter is over LIST_ROWS can be; where documents are so many that all
    counters are, that is a row for each posting, before any is sent.
    """
    shared = reps.sparkSession.sparkContext.broadcast(counts)

    def post(batches: Iterator[pa.RecordBatch]):
        for b in _slices(batches):
            key, n, _ = _prefix(b.column(0), shared.value, s)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > LIST_ROWS].view(np.int64))], ["key"])

    n = F.count(F.lit(1))
    return write_table(reps.select("sig").mapInArrow(post, "key long").groupBy("key").agg(n.alias("n")).filter(F.col("n") > LIST_ROWS).select("key", F.ceil(F.col("n") / LIST_ROWS).cast("long").alias("p")), "long-lists")


def postings(reps: DataFrame, s: Setup, counts: np.ndarray) -> DataFrame:
    """(key, tile, id, n, low): each document under the rarest pairs of its signature.

    A list over LIST_ROWS is dealt out in tiles, so that each two of its
    documents meet in one tile; all others are sent once.
    """
    shared = reps.sparkSession.sparkContext.broadcast(counts)

    def post(batches: Iterator[pa.RecordBatch]):
        for b in _slices(batches):
            key, _, low = _prefix(column(b, "sig"), shared.value, s)
            bits = pa.Array.from_buffers(pa.binary(low.shape[1]), len(low), [None, pa.py_buffer(np.ascontiguousarray(low).tobytes())]).cast(pa.binary())
            at = pa.array(np.repeat(np.arange(b.num_rows), s.prefix))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), column(b, "id").take(at), column(b, "n").take(at), bits.take(at)], ["key", "id", "n", "low"])

    posted = reps.select("id", "n", "sig").mapInArrow(post, "key long, id long, n long, low binary")
    cut = long_lists(reps, s, counts)
    if cut.isEmpty():
        return posted.withColumn("tile", F.lit(0).cast("long"))
    met = posted.join(F.broadcast(cut) if cut.count() <= MAX_BROADCAST_LISTS else cut, "key", "left")
    return _dealt(met.withColumn("p", F.coalesce("p", F.lit(1).cast("long"))), "id", "key", "n", "low")


def _dealt(rows: DataFrame, own: str, *others: str) -> DataFrame:
    """``rows`` in each of the tiles that their part of ``p`` takes part in: tile numbers a pair of parts."""
    mine, other, p = F.pmod(F.xxhash64(own), F.col("p")), F.col("other"), F.col("p")
    each = rows.select(own, *others, "p", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), p - 1)).alias("other"))
    return each.select(own, *others, (F.least("mine", other) * p + F.greatest("mine", other)).alias("tile"))


def _lists(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("key", "tile")) -> Iterator[pa.RecordBatch]:
    """Whole lists of rows that are sorted by integers ``by``, several to a batch; a list has at most two parts of LIST_ROWS or so."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = _starts(b, by)
        if rest and any(column(rest[-1], n)[-1].as_py() != column(b, n)[0].as_py() for n in by):
            yield _joined(rest)
            rest = []
        if len(at) > 1:
            last = int(at[-1])
            yield _joined([*rest, b.slice(0, last)])
            rest = [b.slice(last)]
        else:
            rest.append(b)
    if rest:
        yield _joined(rest)


def _starts(b: pa.RecordBatch, by: tuple[str, ...] = ("key", "tile")) -> np.ndarray:
    """Where a list begins."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for n in by:
        x = column(b, n).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def _bits(b: pa.RecordBatch) -> np.ndarray:
    col = column(b, "low")
    width = len(col[0].as_py())
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    packed = np.frombuffer(col.buffers()[2], np.uint8)[off : off + width * b.num_rows].reshape(-1, width)
    return np.stack([packed >> 4, packed & 15], 2).reshape(b.num_rows, -1)


def _alike(low: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, s: Setup) -> np.ndarray:
    """Which of ``others`` match document i in enough coordinates and may reach the similarity by their sizes."""
    a, b = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    others = others[100 * a >= s.percent * b]
    return others[(low[others] == low[i]).sum(axis=1) >= s.matches]


def list_edges(posted: DataFrame, s: Setup) -> DataFrame:
    """(a, b), distinct: edges that connect all documents of a list that pairs over the match threshold connect.

    A list's first document takes those that match it, the next that is left
    takes its own, and so on; then only documents of different takers are
    compared. A list gives fewer edges than it has documents.
    """

    def merge(batches: Iterator[pa.RecordBatch]):
        for b in _lists(batches):
            at = np.append(_starts(b), b.num_rows)
            if not (np.diff(at) > 1).any():
                continue
            ids, n, low = column(b, "id").to_numpy(), column(b, "n").to_numpy(), _bits(b)
            left, right = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                label, todo, found = np.arange(lo, hi), np.arange(lo, hi), False
                while len(todo) > 1:
                    lead, todo = todo[0], todo[1:]
                    hit = _alike(low, n, lead, todo, s)
                    if len(hit):
                        found = True
                        label[hit - lo] = lead
                        left.append(np.full(len(hit), ids[lead]))
                        right.append(ids[hit])
                        todo = np.setdiff1d(todo, hit, assume_unique=True)
                if not found or hi - lo == 2:
                    continue
                while True:
                    names, size = np.unique(label, return_counts=True)
                    joined = False
                    for i in lo + np.flatnonzero(label != names[size.argmax()]):
                        others = lo + np.flatnonzero(label != label[i - lo])
                        hit = _alike(low, n, i, others, s)
                        if len(hit):
                            joined = True
                            for j in hit[np.unique(label[hit - lo], return_index=True)[1]]:
                                left.append(ids[i : i + 1])
                                right.append(ids[j : j + 1])
                                label[label == label[j - lo]] = label[i - lo]
                    if not joined:
                        break
            if left:
                a, c = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile", "id")
    return write_table(dealt.mapInArrow(merge, "a long, b long").distinct(), "candidates")


def _links(h: np.ndarray, doc: np.ndarray, n: int, s: Setup) -> np.ndarray:
    """Of n documents with shingles (h, doc), a label each that linked ones share."""
    size = np.bincount(doc, minlength=n)
    _, word, count = np.unique(h, return_inverse=True, return_counts=True)
    many = count[word] > 1  # what only one has is in no intersection
    word, doc = np.unique(word[many], return_inverse=True)[1], doc[many]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(word, kind="stable")
    word, doc = word[order], doc[order]
    for a in range(0, int(word[-1]) + 1 if len(word) else 0, MATRIX_COLUMNS):
        i, j = np.searchsorted(word, [a, a + MATRIX_COLUMNS])
        m = np.zeros((n, min(MATRIX_COLUMNS, int(word[-1]) + 1 - a)), np.float32)
        m[doc[i:j], word[i:j] - a] = 1
        shared += m @ m.T
    shared = shared.astype(np.int64)
    link = (100 * shared >= s.percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    label = np.arange(n)
    while True:
        least = np.where(link, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def confirm(clusters: DataFrame, reps: DataFrame, docs: DataFrame, s: Setup) -> DataFrame:
    """(a, b): links that connect what the links between full sets connect; ``clusters`` is (node, label), ``reps`` (id, n), ``docs`` (row, text).

    Only the texts of clusters are sent.  Those of a cluster meet in one task,
    those of a large one in tiles of which each two documents share one; all
    pairs are compared there and a tile gives fewer links than it has documents.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    member = write_table(clusters.join(reps.select(F.col("id").alias("node"), "n"), "node").select(F.col("node").alias("row"), F.col("label").alias("key"), "n"), "members")
    most = F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") / TILE_SHINGLES)
    size = write_table(member.groupBy("key").agg(F.ceil(most).cast("long").alias("p")), "sizes")
    dealt = _dealt(member.select("row", "key").join(size, "key"), "row", "key")
    some = marked(docs, member.select("row"), "_in", "row").filter("_in").drop("_in")
    sent = some.hint("merge").join(dealt, "row").withColumnRenamed("row", "id").repartition(parts, "key", "tile").sortWithinPartitions("key", "tile", "id")

    def check(batches: Iterator[pa.RecordBatch]):
        for b in _lists(batches):
            at = np.append(_starts(b), b.num_rows)
            ids = column(b, "id").to_numpy()
            sets, rows, base = [], [], 0
            for part in blocks(iter([b]), "text", SIGNATURE_BYTES):
                h, r = shingle_sets(*texts(column(part, "text")), s.width)
                sets.append(h)
                rows.append(r + base)
                base += part.num_rows
            h, r = np.concatenate(sets), np.concatenate(rows)
            cut = np.searchsorted(r, at)
            left, right = [], []
            for g in range(len(at) - 1):
                lo, hi = int(at[g]), int(at[g + 1])
                if hi - lo > 1:
                    label = _links(h[cut[g] : cut[g + 1]], r[cut[g] : cut[g + 1]] - lo, hi - lo, s)
                    linked = np.flatnonzero(label != np.arange(hi - lo))
                    left.append(ids[lo + label[linked]])
                    right.append(ids[lo + linked])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return write_table(sent.select("id", "key", "tile", "text").mapInArrow(check, "a long, b long"), "links")


def near_groups(docs: DataFrame, s: Setup = Setup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n, component, stays) of each row of ``docs``: set size, the smallest id that links lead to, whether it is the first row with that.

    Documents with equal sets are one class, whose first row stands for it in
    the search, whatever the ids, which may be of any type that has an order.
    Lists give clusters of what may be linked; in each cluster the full sets
    are compared, and only a tree of its links is kept.

    Null and empty texts have no shingles and no links, and stay.  A row with
    a null id has the component of its group if an id is in that, else null.
    Rows that repeat an id are documents of their own.  An empty table gives
    no rows; other columns do not matter.
    ``docs`` should come from files, as ``row`` numbers its rows.
    """
    plain, _, (i, t) = hide(docs, (), id_col, text_col)
    rows = numbered(plain, "row").select(F.col(i).alias("id"), "row", F.col(t).alias("text"))
    signed = sign(rows, s)
    classes = signed.filter(F.col("n") > 0).groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"))
    named = write_table(signed.drop("sig").join(classes, ["s1", "s2", "n"], "left").select("id", "row", "n", "rep"), "classes")
    reps = write_table(marked(signed.drop("id"), named.filter("rep = row").select("row"), "_in", "row").filter("_in").select(F.col("row").alias("id"), "n", "sig"), "representatives")
    drop_table(signed)
    clusters = components(list_edges(postings(reps, s, pair_counts(reps, s)), s))
    labels = components(confirm(clusters, reps, rows.select("row", "text"), s))
    drop_table(reps)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    own = named.filter("rep is not null").groupBy("rep").agg(first.alias("first"))
    own = own.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("rep", "first", F.coalesce("label", "rep").alias("label"))
    led = own.join(own.groupBy("label").agg(F.min("first").alias("lead")), "label").select("rep", F.col("lead.id").alias("component"), F.col("lead.row").alias("lead"))
    empty = F.col("n") == 0
    return named.join(led, "rep", "left").select("id", "row", "n", F.when(empty, F.col("id")).otherwise(F.col("component")).alias("component"), (empty | (F.col("row") == F.col("lead"))).alias("stays"))


def near_dedup(docs: DataFrame, s: Setup = Setup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each group the one with the smallest id.

    Rows without links and rows of no group stay, null and empty texts among
    them; of rows that repeat the smallest id of a group, and of a group
    without ids, the first in the input's files stays.  An empty table stays
    empty; columns may have any names.
    """
    gone = near_groups(docs, s, id_col, text_col).filter(~F.col("stays")).select(F.col("row").alias("_row"))
    plain, names, _ = hide(docs)
    return marked(numbered(plain), gone, "_gone").filter(~F.col("_gone")).select(*shown(names))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``near_groups`` gives them for two-word shingles; ``kept`` is true of null ids' rows that stay."""
    out = near_groups(table(spark, sf_dir, "documents"), Setup(width=2))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("stays")).alias("kept"))


QUERIES = {"op4_near_dedup": op4_near_dedup}

ORACLE_SQL = {
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 1], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
""",
}
