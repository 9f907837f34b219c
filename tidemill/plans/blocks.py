"""Joins as sets of leaves: a kept join serves every larger one that contains it, in whatever order either was written.

A block is what selections, projections, products and inner joins make of
leaves; its columns are ``(leaf number).(name)``.  A block is contained in
another if its leaves are among the other's, the other has all of its
conjuncts, and its outputs give what the rest of the other asks of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra as A
from .normal import Normal, _expr, _ordered

#: Ways to lay the leaves of a block on those of another that are tried; equal leaves are rare.
MOST_WAYS = 720


@dataclass(frozen=True)
class Block:
    """leaves: queries that are no blocks, with their keys; conj: conjuncts; outs: of each name its expression."""

    leaves: tuple[tuple[A.Query, tuple], ...]
    conj: tuple[A.Expr, ...]
    outs: tuple[tuple[str, A.Expr], ...]


def block(q: A.Query, normal: Callable[[A.Query], Normal]) -> Block:
    """A query as a block; one that is none is a block of itself."""
    if isinstance(q, A.Select):
        b = block(q.child, normal)
        return replace(b, conj=b.conj + tuple(A.normal_clauses(A.replace(q.p, dict(b.outs)))))
    if isinstance(q, A.Project):
        b = block(q.child, normal)
        return replace(b, outs=tuple((n, A.replace(e, dict(b.outs))) for n, e in q.named))
    if isinstance(q, (A.Join, A.Product)):
        l, r = block(q.left, normal), _shift(block(q.right, normal), len(block(q.left, normal).leaves))
        b = Block(l.leaves + r.leaves, l.conj + r.conj, l.outs + r.outs)
        return replace(b, conj=b.conj + tuple(A.normal_clauses(A.replace(q.p, dict(b.outs))))) if isinstance(q, A.Join) else b
    n = normal(q)
    return Block(((q, n.key),), (), tuple((c, A.Col(f"0.{c}")) for c in n.outputs))


def _shift(b: Block, by: int) -> Block:
    return _renumber(b, {i: i + by for i in range(len(b.leaves))})


def _renumber(b: Block, to: dict[int, int]) -> Block:
    def move(e: A.Expr) -> A.Expr:
        names = A.columns_of(e)
        return A.replace(e, {c: A.Col(f"{to[int(c.split('.', 1)[0])]}.{c.split('.', 1)[1]}") for c in names})

    return Block(b.leaves, tuple(move(c) for c in b.conj), tuple((n, move(e)) for n, e in b.outs))


def _form(e: A.Expr) -> tuple:
    return _ordered(_expr(e, _Same()))


class _Same(dict):
    def __missing__(self, name):
        return ("@", *name.split(".", 1))


@dataclass(frozen=True)
class Use:
    """How a block is made from a contained one: the leaves that are left, conjuncts and outputs over these and columns ``v.name`` of the other."""

    rest: tuple[int, ...]
    conj: tuple[A.Expr, ...]
    outs: tuple[tuple[str, A.Expr], ...]


def contained(view: Block, of: Block) -> Use | None:
    """How ``of`` can be made from ``view``, if it can."""
    have = {_form(c) for c in of.conj}
    for to in _ways(view, of):
        v = _renumber(view, to)
        used = {_form(c) for c in v.conj}
        if not used <= have:
            continue
        given = {}
        for n, e in v.outs:
            given.setdefault(_form(e), A.Col(f"v.{n}"))
        covered = set(to.values())
        conj = [_rewrite(c, given, covered) for c in of.conj if _form(c) not in used]
        outs = [(n, _rewrite(e, given, covered)) for n, e in of.outs]
        if all(c is not None for c in conj) and all(e is not None for _, e in outs):
            return Use(tuple(i for i in range(len(of.leaves)) if i not in covered), tuple(conj), tuple(outs))
    return None


def _ways(view: Block, of: Block):
    """Injective maps from the leaves of ``view`` to equal ones of ``of``."""
    if len(view.leaves) > len(of.leaves):
        return
    same = [[j for j, (_, k) in enumerate(of.leaves) if k == key] for _, key in view.leaves]
    groups: dict[tuple, list[int]] = {}
    for i, (_, key) in enumerate(view.leaves):
        groups.setdefault(key, []).append(i)
    ways: list[dict[int, int]] = [{}]
    for key, own in groups.items():
        ways = [w | dict(zip(own, p, strict=True)) for w in ways for p in permutations(same[own[0]], len(own))][:MOST_WAYS]
    yield from ways


def _rewrite(e: A.Expr, given: dict[tuple, A.Expr], covered: set[int]) -> A.Expr | None:
    if (known := given.get(_form(e))) is not None:
        return known
    if isinstance(e, A.Col):
        return None if int(e.name.split(".", 1)[0]) in covered else e
    if isinstance(e, A.Call):
        args = [_rewrite(a, given, covered) for a in e.args]
        return None if any(a is None for a in args) else A.Call(e.op, tuple(args))
    return e


def make(use: Use, view: DataFrame, rest: list[DataFrame]) -> DataFrame:
    """The block from its parts; each next part is joined by the conjuncts that it completes, connected ones first."""
    frames = [_tagged(view, "v"), *(_tagged(d, str(i)) for i, d in zip(use.rest, rest, strict=True))]
    todo = [A.replace(c, {n: A.Col(_plain(n)) for n in A.columns_of(c)}) for c in use.conj]
    done, frames = frames[0], frames[1:]
    done, todo = _apply(done, todo)
    while frames:
        have = set(done.columns)
        touches = [sum(bool(A.columns_of(c) & set(f.columns)) and A.columns_of(c) <= have | set(f.columns) for c in todo) for f in frames]
        f = frames.pop(touches.index(max(touches)))
        both = have | set(f.columns)
        on = [c for c in todo if A.columns_of(c) <= both]
        todo = [c for c in todo if c not in on]
        done = done.join(f, reduce(lambda x, y: x & y, map(A.column, on))) if on else done.crossJoin(f)
    return done.select(*(A.column(A.replace(e, {n: A.Col(_plain(n)) for n in A.columns_of(e)})).alias(name) for name, e in use.outs))


def _apply(df: DataFrame, todo: list[A.Expr]) -> tuple[DataFrame, list[A.Expr]]:
    now = [c for c in todo if A.columns_of(c) <= set(df.columns)]
    for c in now:
        df = df.filter(A.column(c))
    return df, [c for c in todo if c not in now]


def _plain(name: str) -> str:
    tag, _, column = name.partition(".")
    return f"{tag}__{column}"


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{tag}__{c}") for c in df.columns))
