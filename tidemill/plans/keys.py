"""Shapes of queries: columns, unique keys and estimated sizes; and the exposure of keys that a query would lose."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product as pairs

from . import algebra as A

#: Rows of a selection, limit or drop as a share of the input; rows of a group; share of pairs that a join keeps.
KEPT, GROUP_ROWS, JOINED = 0.5, 10, 1 / 3
#: Shares of a side that a join matches and leaves.
MATCHED, UNMATCHED = 0.7, 0.3


@dataclass(frozen=True)
class Shape:
    """keys: sets of columns that are unique; sure: certainty of rows, 1 for what was counted."""

    columns: tuple[str, ...]
    keys: tuple[frozenset, ...]
    rows: float
    row_bytes: float
    sure: float = 1.0

    @property
    def pages(self) -> int:
        return pages(self.rows * self.row_bytes)


PAGE = 4096


def pages(size: float) -> int:
    return int(-(-size // PAGE)) if size > 0 else 0


def _minimal(keys) -> tuple[frozenset, ...]:
    keys = set(keys)
    return tuple(sorted((k for k in keys if not any(o < k for o in keys)), key=lambda k: (len(k), sorted(k))))


def _equal_columns(p: A.Expr) -> list[tuple[str, str]]:
    return [(c.args[0].name, c.args[1].name) for c in A.conjuncts(p) if isinstance(c, A.Call) and c.op == "=" and all(isinstance(a, A.Col) for a in c.args)]


def looks_up(p: A.Expr, side: Shape) -> bool:
    """Whether equalities of ``p`` cover a unique key of ``side``, so that each row of the other finds one at most."""
    own = {c for pair in _equal_columns(p) for c in pair if c in side.columns}
    return any(k <= own for k in side.keys)


def shape(q: A.Query, base: dict[str, Shape], measured: dict[A.Query, Shape] | None = None) -> Shape:
    """The shape of a query over base tables; sizes of queries in ``measured`` are known, and what is made from them is estimated from these."""
    if measured and q in measured:
        return measured[q]
    if isinstance(q, A.Rel):
        return base[q.name]
    s = [shape(c, base, measured) for c in A.children(q)]
    if isinstance(q, A.Distinct):
        return Shape(s[0].columns, _minimal([*s[0].keys, frozenset(s[0].columns)]), s[0].rows * KEPT, s[0].row_bytes, s[0].sure * KEPT)
    if isinstance(q, (A.Select, A.Limit, A.Drop)):
        rows = s[0].rows * KEPT
        if isinstance(q, A.Limit) and q.n >= 0:
            rows = min(s[0].rows, q.n)
        return Shape(s[0].columns, s[0].keys, rows, s[0].row_bytes, s[0].sure * KEPT)
    if isinstance(q, A.Sort):
        return s[0]
    if isinstance(q, A.Project):
        names: dict[str, list[str]] = {}
        for n, e in q.named:
            if isinstance(e, A.Col):
                names.setdefault(e.name, []).append(n)
        keys = [frozenset(c) for k in s[0].keys if all(x in names for x in k) for c in pairs(*(names[x] for x in sorted(k)))]
        width = s[0].row_bytes * len(q.named) / max(1, len(s[0].columns))
        return Shape(tuple(n for n, _ in q.named), _minimal(keys), s[0].rows, width, s[0].sure)
    if isinstance(q, A.Group):
        given = {e.name: n for n, e in q.named if isinstance(e, A.Col)}
        plain = [k.name for k in q.keys if isinstance(k, A.Col)]
        keys = [frozenset(given[k] for k in plain)] if len(plain) == len(q.keys) and all(k in given for k in plain) else []
        width = 8.0 * len(q.named)
        return Shape(tuple(n for n, _ in q.named), tuple(keys), GROUP_ROWS if q.keys else 1, width, 0.1 if q.keys else 1.0)
    a, b = s
    if isinstance(q, A.Union):
        return Shape(a.columns, (), a.rows + b.rows, a.row_bytes, min(a.sure, b.sure))
    if isinstance(q, (A.LeftAnti, A.RightAnti, A.Semi)):
        own, other = (b, a) if isinstance(q, A.RightAnti) else (a, b)
        share = MATCHED if isinstance(q, A.Semi) else 0.0 if looks_up(q.p, other) else UNMATCHED
        return Shape(own.columns, own.keys, own.rows * share, own.row_bytes, own.sure * KEPT)
    both = [x | y for x in a.keys for y in b.keys]
    p = getattr(q, "p", None)
    rows = a.rows * b.rows
    sure = a.sure * b.sure
    if p is not None:
        keys = list(both)
        if to_b := looks_up(p, b):
            keys += a.keys
        if to_a := looks_up(p, a):
            keys += b.keys
        both = keys if not isinstance(q, A.LeftOuter) else [*both, *(a.keys if to_b else ())]
        rows = a.rows if to_b else b.rows if to_a else rows * JOINED
        sure *= 1.0 if to_a or to_b else KEPT
    return Shape(a.columns + b.columns, _minimal(both), rows, a.row_bytes + b.row_bytes, sure)


def expose_keys(q: A.Query, base: dict[str, Shape]) -> A.Query:
    """The query with key columns added to projections and groups that would lose every key of their input."""
    if isinstance(q, A.Rel):
        return q
    if isinstance(q, A.Project):
        child = expose_keys(q.child, base)
        q = A.Project(q.named, child)
        inner = shape(child, base)
        if inner.keys and not shape(q, base).keys:
            have = {n for n, _ in q.named}
            kept = {e.name for _, e in q.named if isinstance(e, A.Col)}
            extra = tuple((k if k not in have else f"key_{k}", A.Col(k)) for k in sorted(inner.keys[0] - kept))
            q = A.Project(q.named + extra, child)
        return q
    if isinstance(q, A.Group):
        child = expose_keys(q.child, base)
        have = {n for n, _ in q.named}
        shown = {e for _, e in q.named}
        extra = tuple((k.name if k.name not in have else f"key_{k.name}", k) for k in q.keys if isinstance(k, A.Col) and k not in shown)
        return A.Group(q.named + extra, q.keys, child)
    kids = [expose_keys(c, base) for c in A.children(q)]
    return with_children(q, kids)


def with_children(q: A.Query, kids: list[A.Query]) -> A.Query:
    if isinstance(q, A.Rel):
        return q
    if hasattr(q, "child"):
        return type(q)(*(kids[0] if f == "child" else getattr(q, f) for f in q.__dataclass_fields__))
    return type(q)(*(kids[0] if f == "left" else kids[1] if f == "right" else getattr(q, f) for f in q.__dataclass_fields__))


def recoverable(named: tuple, columns: tuple[str, ...]) -> dict[str, A.Expr]:
    """Columns of the input in terms of a projection's outputs, where its expressions can be inverted without loss.

    That holds of columns and their negation whatever their type; sums and
    products may round or change the type.
    """
    out: dict[str, A.Expr] = {}
    for c in columns:
        for n, e in named:
            if A.columns_of(e) == {c} and (back := A.invert(e, c, A.Col(n))) is not None and _exact(e):
                out[c] = back
                break
    return out


def _exact(e: A.Expr) -> bool:
    return isinstance(e, A.Col) or (isinstance(e, A.Call) and e.op == "neg" and _exact(e.args[0]))
