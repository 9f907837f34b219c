"""SentencePiece encoding and decoding: Gumbel top-k without replacement.

A text's segmentations are the paths of a lattice of pieces.  A path's
perturbed value is its log probability plus Gumbel noise; the k paths with
the largest values are k draws without replacement.  The search never lists
paths: it draws the best path of a set of paths and the value of each set
that branches off it, and goes on with the best set in a queue (A-star over
the perturbed values).  The next value in the queue gives each draw's
inclusion probability.  All noise is a hash of the row's key.

The vocabulary is byte-complete BPE, whose scores are ranks; a piece of rank r
is given probability in proportion to 1 / (r + 2) (Zipf's law).  Segments begin
with a run of spaces and end where no piece goes on into the next, so lattices
of distinct segments are built once and shared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hide, shown, table
from .token_counts import NONE, Automaton, build
from .vectors import blocks, column, hash_spans, mix, texts

_U = np.uint64
#: Segmentations that are drawn of each text.
SAMPLES = 2
#: Edges of lattices that a task keeps for segments it has seen; beyond, it starts anew. Bytes of segments whose lattices are built at once, and of texts that are drawn from at once.
CACHED_EDGES, BUILD_BYTES, TEXT_BYTES = 3_000_000, 1 << 16, 1 << 19
SPACE = 0x20
#: Gumbel noise made from 53 random bits is never over this; places of a path that are valued at once.
MOST_NOISE, STRETCH = 37.5, 192


class Steps:
    """The edges of a trie as a bitmap of the bytes that go on from each node; a step takes no search."""

    def __init__(self, trie: Automaton):
        keys = trie.keys[trie.keys >= 0]
        word = keys >> 6
        self.bits = np.zeros(4 * len(trie.fail), _U)
        np.bitwise_or.at(self.bits, word, _U(1) << (keys & 63).astype(_U))
        self.base = np.searchsorted(word, np.arange(len(self.bits))).astype(np.int32)
        self.to = trie.to.astype(np.int32)

    def go(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which steps there are, and where these lead."""
        at, low = (node.astype(np.int64) << 2) | (byte >> 6), (byte & 63).astype(_U)
        bits = self.bits[at]
        ok = np.flatnonzero((bits >> low) & _U(1))
        below = bits[ok] & ((_U(1) << low[ok]) - _U(1))
        return ok, self.to[self.base[at[ok]] + np.bitwise_count(below)]


@dataclass
class Pieces:
    """A vocabulary as a trie over bytes: pieces by node, log probabilities and bytes by id.

    ``across``: a trie of the pieces with a space behind another character and
    where they end in it, None if there are none.
    """

    steps: Steps
    piece_of: np.ndarray
    logp: np.ndarray
    spelled: list[bytes]
    byte_id: np.ndarray
    across: tuple[Steps, np.ndarray] | None


def load_pieces(path: str | None = None) -> Pieces:
    """The pieces of a SentencePiece model with byte fallback; None is the one that is installed."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled, byte_id = [b""] * m.get_piece_size(), np.full(256, NONE, np.int64)
    whole: dict[bytes, int] = {}
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            b = int(m.id_to_piece(i)[3:5], 16)
            spelled[i], byte_id[b] = bytes([b]), i
        elif not (m.is_unknown(i) or m.is_control(i)):
            spelled[i] = m.id_to_piece(i).replace("▁", " ").encode()
            whole.setdefault(spelled[i], i)
    return make_pieces(spelled, whole, byte_id)


def make_pieces(spelled: list[bytes], whole: dict[bytes, int], byte_id: np.ndarray) -> Pieces:
    """spelled: bytes of each id; whole: the ids that may be edges, by rank; byte_id: of each byte the id that spells it."""
    logp = np.full(len(spelled), 0.0)
    for rank, i in enumerate(sorted(whole.values())):
        logp[i] = -np.log(rank + 2.0)
    logp[byte_id[byte_id >= 0]] = -np.log(len(whole) + 2.0) - 1
    steps, node = _spelled_out(list(whole))
    piece_of = np.full(len(steps.bits) // 4, NONE, np.int64)
    piece_of[node] = list(whole.values())
    across = None
    if far := [w for w in whole if b" " in w.lstrip(b" ")]:
        far_steps, node = _spelled_out(far)
        ends = np.zeros(len(far_steps.bits) // 4, bool)
        ends[node] = True
        across = far_steps, ends
    return Pieces(steps, piece_of, logp, spelled, byte_id, across)


def _spelled_out(pieces: list[bytes]) -> tuple[Steps, np.ndarray]:
    """The trie of ``pieces`` and the node of each."""
    steps = Steps(build(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(w) for w in pieces], np.int64)
    at, node = np.cumsum(size) - size, np.zeros(len(size), np.int64)
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        node[live] = steps.go(node[live], data[at[live] + d])[1]
    return steps, node


def segment_starts(p: Pieces, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where segments begin: at rows and at runs of spaces, but where a piece goes on from before."""
    cut = data == SPACE
    cut[1:] &= data[:-1] != SPACE  # a run of spaces lies in one segment
    if p.across is not None:
        steps, ends = p.across
        last = np.repeat(off[1:], np.diff(off))
        over = np.zeros(len(data) + 1, np.int64)
        src, state, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(src):
            ok, state = steps.go(state, data[src + depth])
            src, depth = src[ok], depth + 1
            whole = src[ends[state]]
            np.add.at(over, whole + 1, 1)
            np.add.at(over, whole + depth, -1)
            more = src + depth < last[src]
            src, state = src[more], state[more]
        cut &= np.cumsum(over[:-1]) == 0
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Lattices:
    """Lattices of the segments seen so far.

    A node is a place in a segment, with one more for its end.  Edges are
    ordered by node, the likeliest first; first[node] is NONE at an end.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        # room at once, of which the system gives what is used
        most = CACHED_EDGES + CACHED_EDGES // 4
        self.first = np.empty(most, np.int32)
        self.to, self.piece, self.size = (np.empty(most, np.int32) for _ in range(3))
        self.logp, self.cum = np.empty(most), np.empty(most)
        self.clear()

    def clear(self) -> None:
        self.known, self.root = np.zeros(0, _U), np.zeros(0, np.int64)
        self.nodes = self.edges = 0

    def _room(self, name: str, used: int, new: np.ndarray) -> None:
        """Append to an array that has spare room at its end."""
        old = getattr(self, name)
        if used + len(new) > len(old):
            grown = np.empty(max(used + len(new), len(old) * 5 // 4), old.dtype)
            grown[:used] = old[:used]
            setattr(self, name, old := grown)
        old[used : used + len(new)] = new

    def roots(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first nodes of distinct segments (hashes ascending)."""
        if self.edges > CACHED_EDGES:
            self.clear()
        i = np.searchsorted(self.known, hashes)
        i[i == len(self.known)] = 0
        new = np.ones(len(hashes), bool) if not len(self.known) else self.known[i] != hashes
        if new.any():
            first, last = start[new], end[new]
            part = np.cumsum(last - first) // BUILD_BYTES
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            root = np.concatenate([self._add(data, a, b) for a, b in zip(np.split(first, cuts), np.split(last, cuts), strict=True)])
            known, roots = np.concatenate([self.known, hashes[new]]), np.concatenate([self.root, root])
            order = np.argsort(known, kind="stable")
            self.known, self.root = known[order], roots[order]
        return self.root[np.searchsorted(self.known, hashes)]

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.p
        size = end - start
        base = np.cumsum(size + 1) - (size + 1)
        n_nodes = int((size + 1).sum())
        owner = np.repeat(np.arange(len(size)), size)
        off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        byte = data[start[owner] + off]
        node = base[owner] + off
        left = size[owner] - off
        inside = (byte & 0xC0) == 0x80
        inside[off == 0] = False
        live = np.flatnonzero(~inside)
        state = np.zeros(len(live), np.int64)
        e_from, e_len, e_piece = [], [], []
        src, depth = live, 0
        while len(src):
            ok, state = p.steps.go(state, byte[src + depth])
            src = src[ok]
            depth += 1
            is_piece = p.piece_of[state] != NONE
            e_from.append(src[is_piece])
            e_len.append(np.full(int(is_piece.sum()), depth))
            e_piece.append(p.piece_of[state[is_piece]])
            more = left[src] > depth
            src, state = src[more], state[more]
        # a character that is no piece is spelled by its bytes
        nxt = np.append(live[1:], len(byte))
        width = np.minimum(nxt - live, left[live])
        spelled_at = np.zeros(len(byte), np.int64)
        for f, n in zip(e_from, e_len, strict=True):
            spelled_at[f] |= np.where(n < 63, 1 << np.minimum(n, 62), 0)
        missing = (spelled_at[live] >> width) & 1 == 0
        e_from.append(live[missing])
        e_len.append(width[missing])
        e_piece.append(np.full(int(missing.sum()), NONE))
        f, n, piece = np.concatenate(e_from), np.concatenate(e_len), np.concatenate(e_piece)
        lp = np.where(piece != NONE, p.logp[piece], n * p.logp[p.byte_id[byte[0]]] if len(byte) else 0.0)
        beta = np.full(n_nodes, -np.inf)
        beta[base + size] = 0.0
        order = np.argsort(left[f] << 32 | node[f])
        f, n, piece, lp = f[order], n[order], piece[order], lp[order]
        rest, src, dst = left[f], node[f], node[f] + n
        value = np.empty(len(f))
        bounds = np.flatnonzero(np.append(True, rest[1:] != rest[:-1])) if len(f) else np.zeros(0, np.int64)
        for a, b in zip(bounds, [*bounds[1:], len(f)], strict=True):
            v = lp[a:b] + beta[dst[a:b]]
            g = np.flatnonzero(np.append(True, src[a + 1 : b] != src[a : b - 1]))
            top = np.maximum.reduceat(v, g)
            count = np.diff(np.append(g, b - a))
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), g))
            beta[src[a:b][g]] = total
            value[a:b] = v - np.repeat(total, count)
        # by node, then likeliest first: the bits of floats that are not negative are in their order
        order = np.argsort(src << 32 | (-value).clip(0).astype(np.float32).view(np.uint32))
        src, dst, n, piece, value = src[order], dst[order], n[order], piece[order], value[order]
        g = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.zeros(0, np.int64)
        total = np.concatenate(([0.0], np.cumsum(np.exp(value))))
        cum = total[1:] - np.repeat(total[g], np.diff(np.append(g, len(src))))
        cum[np.append(g[1:], len(src)) - 1] = 2.0  # the last edge of a node takes what rounding leaves
        first = np.full(n_nodes, NONE, np.int64)
        first[src[g]] = g + self.edges
        nodes = self.nodes
        self._room("first", nodes, first)
        for name, new in (("to", dst + nodes), ("piece", piece), ("size", n), ("logp", value), ("cum", cum)):
            self._room(name, self.edges, new)
        self.nodes += n_nodes
        self.edges += len(src)
        return base + nodes

    def edges_of(self, node: int) -> range:
        a = b = int(self.first[node])
        while self.cum[b] < 2.0:
            b += 1
        return range(a, b + 1)

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path from each start to its end, one path after another, and their numbers."""
        node, count, taken, step = start.copy(), np.zeros(len(start), np.int64), [], 0
        live = np.flatnonzero(self.first[node] != NONE)
        while len(live):
            u = uniform(key[live], step)
            e = self.first[node[live]].astype(np.int64)
            todo = np.flatnonzero(u >= self.cum[e])
            while len(todo):
                e[todo] += 1
                todo = todo[u[todo] >= self.cum[e[todo]]]
            taken.append((live, e))
            count[live] += 1
            node[live] = self.to[e]
            live = live[self.first[node[live]] != NONE]
            step += 1
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for s, (live, e) in enumerate(taken):
            out[at[live] + s] = e
        return out, count


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    h = mix(key + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated_gumbel(phi: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with location phi, given that they are below ``most``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = phi - np.log(np.exp(np.minimum(phi - most, 700.0)) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(g, most))


@dataclass
class Draw:
    """A drawn path: its edges, log probability before each, its value."""

    edges: np.ndarray
    before: np.ndarray
    logp: float
    value: float
    inclusion: float = 1.0


class Search:
    """The queue of one row: sets of paths, the best value first."""

    def __init__(self, lat: Lattices, k: int, key: int):
        self.lat, self.k, self.key = lat, k, key
        self.queue: list[tuple[float, int, int, tuple]] = []
        self.draws: list[Draw] = []

    def add(self, edges: np.ndarray, kept: int, before: float, prefix: Draw | None, value: float, tried: tuple) -> None:
        """Take a path; ``edges`` are those from place ``kept`` on, reached with log probability ``before``.

        ``tried``: edges that are used up at place kept - 1, where it branched off.
        """
        lat, number = self.lat, len(self.draws)
        run = before + np.concatenate(([0.0], np.cumsum(lat.logp[edges])))
        if prefix is None:
            draw = Draw(edges, run[:-1], float(run[-1]), value)
        else:
            draw = Draw(np.concatenate([prefix.edges[: kept - 1], [tried[-1]], edges]), np.concatenate([prefix.before[:kept], run[:-1]]), float(run[-1]), value)
        self.draws.append(draw)
        if prefix is not None:
            self._rest(number, kept - 1, tried, value)
        for a in range(0, len(edges), STRETCH):
            least = self.queue_floor()
            if run[a] < least - MOST_NOISE:
                break  # nothing further on can come among the next k
            e = edges[a : a + STRETCH]
            with np.errstate(divide="ignore"):
                phi = run[a : a + len(e)] + np.log(-np.expm1(lat.logp[e]))
            phi[lat.cum[lat.first[self._from(e)]] >= 2.0] = -np.inf  # no other edge
            place = np.arange(kept + a, kept + a + len(e))
            g = truncated_gumbel(phi, value, uniform(place.astype(_U) + _U(self.key), 3 + number))
            best = np.flatnonzero(g > least)
            if len(best) > self.k:
                best = best[np.argpartition(-g[best], self.k)[: self.k]]
            for i in best:
                heapq.heappush(self.queue, (-float(g[i]), number, int(place[i]), (int(e[i]),)))

    def queue_floor(self) -> float:
        """The k-th best value of the queue: what is below it never leads to one of the draws."""
        if len(self.queue) < self.k:
            return -np.inf
        if len(self.queue) > self.k:
            self.queue = heapq.nsmallest(self.k, self.queue)
        return -max(self.queue)[0]

    def _from(self, edges: np.ndarray) -> np.ndarray:
        return self.lat.to[edges] - self.lat.size[edges]

    def _left(self, draw: Draw, place: int, tried: tuple) -> list[int]:
        node = int(self._from(draw.edges[place : place + 1])[0])
        return [e for e in self.lat.edges_of(node) if e not in tried]

    def _rest(self, number: int, place: int, tried: tuple, value: float) -> None:
        """The set at ``place`` without all edges that were tried there."""
        draw = self.draws[number]
        if left := self._left(draw, place, tried):
            phi = np.array([draw.before[place] + np.log(np.exp(self.lat.logp[left]).sum())])
            u = uniform(np.array([place + (len(tried) << 40)], _U) + _U(self.key), 3 + number)
            heapq.heappush(self.queue, (-float(truncated_gumbel(phi, value, u)[0]), number, place, tried))

    def branch(self) -> tuple[float, Draw, int, tuple, int] | None:
        """The best set: its value, the draw it branches off, the place, the edges tried with a new one, and where that leads."""
        if not self.queue:
            return None
        value, number, place, tried = heapq.heappop(self.queue)
        draw = self.draws[number]
        left = self._left(draw, place, tried)
        cum = np.cumsum(np.exp(self.lat.logp[left]))
        u = uniform(np.array([place], _U) + _U(self.key), 1000 + len(self.draws))[0] * cum[-1]
        edge = left[min(int(np.searchsorted(cum, u, "right")), len(left) - 1)]
        return -value, draw, place, (*tried, edge), int(self.lat.to[edge])


def sample_block(lat: Lattices, data: np.ndarray, off: np.ndarray, keys: np.ndarray, k: int) -> list[list[Draw]]:
    """The draws of each row of a block."""
    n = len(off) - 1
    start = segment_starts(lat.p, data, off)
    row = np.searchsorted(off, start, "right") - 1
    end = np.append(start[1:], len(data))
    hashes = hash_spans(data, start, end)
    h, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    root = lat.roots(h, data, start[at], end[at])[place]
    seg = np.searchsorted(row, np.arange(n + 1))
    local = np.arange(len(start)) - seg[row]
    word_key = mix(keys[row] + local.astype(_U) * _U(0xA0761D6478BD642F))
    edges, count = lat.walk(root, mix(word_key + _U(1)))
    done = np.concatenate(([0], np.cumsum(count)))
    searches = []
    for i in range(n):
        s = Search(lat, k, int(mix(keys[i : i + 1] + _U(99))[0]) & (2**62 - 1))
        g = float(-np.log(-np.log(uniform(keys[i : i + 1], 2)[0])))
        s.add(edges[done[seg[i]] : done[seg[i + 1]]], 0, 0.0, None, g, ())
        searches.append(s)
    for number in range(1, k):
        found = [(i, b) for i, s in enumerate(searches) if (b := s.branch()) is not None]
        if not found:
            break
        starts, key, sizes = [], [], []
        for i, (_, draw, at_piece, _, node) in found:
            # which segment the branching edge is in: count the segment ends before it
            ended = int((lat.first[lat.to[draw.edges[:at_piece]]] == NONE).sum())
            later = seg[i] + ended + 1
            starts += [np.array([node]), root[later : seg[i + 1]]]
            key += [word_key[seg[i] + ended : seg[i] + ended + 1] + _U(7), word_key[later : seg[i + 1]]]
            sizes.append(1 + seg[i + 1] - later)
        more, count = lat.walk(np.concatenate(starts), mix(np.concatenate(key) + _U(number + 1)))
        ends = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(sizes)))]
        for (i, (value, draw, at_piece, tried, _)), a, b in zip(found, ends[:-1], ends[1:], strict=True):
            before = float(draw.before[at_piece] + lat.logp[tried[-1]])
            searches[i].add(more[a:b], at_piece + 1, before, draw, value, tried)
    for s in searches:
        bound = -min(s.queue)[0] if s.queue else -np.inf
        for d in s.draws:
            d.inclusion = float(-np.expm1(-np.exp(min(d.logp - bound, 50.0)))) if bound > -np.inf else 1.0
    return [s.draws for s in searches]


def piece_ids(lat: Lattices, edges: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ids along a path over the bytes ``data``; characters that are no pieces by their bytes."""
    piece, size = lat.piece[edges], lat.size[edges].astype(np.int64)
    if (piece != NONE).all():
        return piece
    width = np.where(piece == NONE, size, 1)
    out = np.repeat(piece, width)
    at = np.repeat(np.cumsum(size) - size, width) + np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
    by_byte = out == NONE
    out[by_byte] = lat.p.byte_id[data[at[by_byte]]]
    return out.astype(np.int32)


class Decoder:
    """Ids to bytes, many at once."""

    def __init__(self, spelled: list[bytes]):
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(x) for x in spelled])
        self.at = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[ids], n)
        return self.flat[place].tobytes()


def _encoded(docs: DataFrame, pieces: Pieces, k: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    plain, _, (i, t) = hide(docs, (), id_col, text_col)
    rows = plain.select(F.col(i).alias("id"), F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit(""))).alias("key"), F.col(t).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # grows with the vocabulary only

    def one_block(lat: Lattices, decode: Decoder, b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = texts(column(b, "text"))
        drawn = sample_block(lat, data, off, column(b, "key").to_numpy().view(_U), k)
        row, number, ids, logp, inclusion, same = [], [], [], [], [], []
        for i, draws in enumerate(drawn):
            own = data[off[i] : off[i + 1]]
            for j, d in enumerate(draws):
                x = piece_ids(lat, d.edges, own)
                row.append(i)
                number.append(j)
                ids.append(x)
                logp.append(d.logp)
                inclusion.append(d.inclusion)
                if digest:
                    same.append(decode(x) == own.tobytes())
        size = np.array([len(x) for x in ids], np.int64)
        out = [column(b, "id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
        if digest:
            out += [pa.array(size), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array(same, pa.bool_())]
        else:
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat, pa.int32())))
        return pa.RecordBatch.from_arrays([*out, pa.array(logp, pa.float64()), pa.array(inclusion, pa.float64())], ["id", "sample", *(["n_pieces", "ids_sha256", "round_trip"] if digest else ["ids"]), "logp", "inclusion"])

    def encode(batches: Iterator[pa.RecordBatch]):
        lat, decode = Lattices(shared.value), Decoder(shared.value.spelled)
        for b in blocks(batches, "text", TEXT_BYTES):
            yield one_block(lat, decode, b)

    middle = "n_pieces long, ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, sample int, {middle}, logp double, inclusion double")


def encode(docs: DataFrame, pieces: Pieces, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sample, ids, logp, inclusion): up to ``k`` distinct segmentations of each text.

    They are draws without replacement, in the order of their perturbed
    values; logp is normalised over the text's segmentations, and inclusion is
    the chance to be over the next value.  A text with fewer segmentations
    gets all of them with inclusion 1; a null or empty text gets the empty one.
    Equal ids and texts get equal draws, whatever the partitions.  An empty
    table gives no rows; other columns are left out.
    """
    return _encoded(docs, pieces, k, id_col, text_col, False)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of ``encoded`` plus the text that the ids spell.

    Null ids give null, empty ones the empty text; an empty table stays empty;
    a column of the text's name is replaced, any other names may occur.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces.spelled)
    rows, hidden, (ids_col,) = hide(encoded, (text_col,), ids_col)
    names = list(hidden)

    def spell(batches: Iterator[pa.RecordBatch]):
        d = Decoder(shared.value)
        for b in batches:
            out = [None if x is None else d(np.array(x, np.int64)).decode() for x in column(b, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(out, pa.string())], [*names, "_spelled"])

    return rows.mapInArrow(spell, rows.select(*names).schema.add("_spelled", "string")).select(*shown(hidden), F.col("_spelled").alias(text_col))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each of ``documents``, as ``encode`` gives them, with the ids' number and digest and whether they spell the text again."""
    out = _encoded(table(spark, sf_dir, "documents"), load_pieces(), SAMPLES, "doc_id", "text", True)
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
