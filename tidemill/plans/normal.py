"""Normal forms: equal keys for queries that are equal up to rewrites.

A block of selections, projections and joins is a bag of terms, a set of
conjuncts and a bag of output expressions over the terms' columns; names of
outputs do not count. Groups, antijoins, sorts and the like are terms of the
blocks around them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count, permutations, product

from . import algebra as A

#: Orders of repeated terms that are tried for the smallest form; beyond, terms that stay alike after refining keep the order of the query.
MOST_ORDERS = 5040
_SYMMETRIC = {"+", "*", "=", "and", "or"}


@dataclass(frozen=True)
class Normal:
    """key: hashable identity; outputs: of each name its expression over the key's terms."""

    key: tuple
    outputs: dict[str, tuple]

    def __hash__(self):
        return hash(self.key)


@dataclass
class _Block:
    terms: dict[int, tuple]  # of each use of a term, its key
    conj: list
    out: dict[str, tuple]


def _expr(e: A.Expr, env: dict[str, tuple]) -> tuple:
    if isinstance(e, A.Col):
        return env[e.name]
    if isinstance(e, A.Lit):
        return ("lit", type(e.value).__name__, repr(e.value))
    if isinstance(e, A.Agg):
        return ("agg", e.fn, ("lit", "int", "1") if e.arg is None else _expr(e.arg, env))
    return _ordered((e.op, *(_expr(a, env) for a in e.args)))


def _ordered(t):
    """The expression with flat, sorted arguments where order does not matter."""
    if not isinstance(t, tuple) or not t or t[0] in ("lit", "@"):
        return t
    args = [_ordered(a) for a in t[1:]]
    if t[0] in _SYMMETRIC:
        if t[0] != "=":
            args = [x for a in args for x in (a[1:] if isinstance(a, tuple) and a[0] == t[0] else (a,))]
        if t[0] in ("and", "or"):
            args = list(dict.fromkeys(args))
        args.sort(key=repr)
    return (t[0], *args)


def _rename(t, by: dict[int, int]):
    if isinstance(t, tuple):
        if len(t) == 3 and t[0] == "@":
            return ("@", by[t[1]], t[2])
        return tuple(_rename(x, by) for x in t)
    return t


def _seal(b: _Block) -> Normal:
    """Number the terms so that the form is smallest among the orders of repeated terms.

    Terms are first told apart by what they are, then by how conjuncts and
    outputs use them and whom they meet there; only orders of terms that are
    alike in all that are tried.
    """
    colour = {use: repr(key) for use, key in b.terms.items()}
    parts = [("conj", c) for c in b.conj] + [("out", e) for e in b.out.values()]
    while len(set(colour.values())) < len(colour):
        seen: dict[int, list[str]] = {use: [] for use in colour}
        for kind, e in parts:
            for use in _uses(e):
                marked = repr((kind, _ordered(_rename(e, {u: (colour[u], u == use) for u in colour}))))
                seen[use].append(marked)
        new = {use: repr((colour[use], sorted(seen[use]))) for use in colour}
        names = {c: f"{i:06d}" for i, c in enumerate(sorted(set(new.values())))}
        new = {use: names[c] for use, c in new.items()}
        if len(set(new.values())) == len(set(colour.values())):
            break
        colour = new
    groups: dict[tuple[str, str], list[int]] = {}
    for use, key in b.terms.items():
        groups.setdefault((repr(key), colour[use]), []).append(use)
    names = sorted(groups)
    total = 1
    for g in groups.values():
        for i in range(2, len(g) + 1):
            total *= i
    orders = product(*(permutations(groups[n]) if total <= MOST_ORDERS else [tuple(groups[n])] for n in names))
    best = None
    for order in orders:
        uses = [u for g in order for u in g]
        by = {u: i for i, u in enumerate(uses)}
        conj = tuple(sorted({_ordered(_rename(c, by)) for c in b.conj}, key=repr))
        out = {n: _ordered(_rename(e, by)) for n, e in b.out.items()}
        form = (conj, tuple(sorted(out.values(), key=repr)))
        if best is None or repr(form) < repr(best[0]):
            best = (form, out, uses)
    form, out, uses = best
    return Normal(("block", tuple(b.terms[u] for u in uses), *form), out)


def _uses(t) -> set[int]:
    if isinstance(t, tuple):
        if len(t) == 3 and t[0] == "@":
            return {t[1]}
        return set().union(*(_uses(x) for x in t))
    return set()


def _conj(p: A.Expr, env: dict[str, tuple]) -> list[tuple]:
    return [_expr(c, env) for c in A.normal_clauses(p)]


def _opaque(kind: tuple, inner: Normal, ids) -> _Block:
    use = next(ids)
    return _Block({use: kind}, [], {n: ("@", use, repr(e)) for n, e in inner.outputs.items()})


def _block(q: A.Query, columns: dict[str, tuple[str, ...]], ids) -> _Block:
    if isinstance(q, A.Rel):
        use = next(ids)
        return _Block({use: ("rel", q.name)}, [], {c: ("@", use, c) for c in columns[q.name]})
    if isinstance(q, A.Select):
        b = _block(q.child, columns, ids)
        b.conj += _conj(q.p, b.out)
        return b
    if isinstance(q, A.Project):
        b = _block(q.child, columns, ids)
        b.out = {n: _expr(e, b.out) for n, e in q.named}
        return b
    if isinstance(q, (A.Product, A.Join)):
        left, right = _block(q.left, columns, ids), _block(q.right, columns, ids)
        b = _Block({**left.terms, **right.terms}, left.conj + right.conj, {**left.out, **right.out})
        if isinstance(q, A.Join):
            b.conj += _conj(q.p, b.out)
        return b
    if isinstance(q, A.Group):
        b = _block(q.child, columns, ids)
        b.out = {**{f"key {i}": _expr(k, b.out) for i, k in enumerate(q.keys)}, **{f"out {n}": _expr(e, b.out) for n, e in q.named}}
        n = _seal(b)
        keys = tuple(sorted({n.outputs[f"key {i}"] for i in range(len(q.keys))}, key=repr))
        outs = {k: n.outputs[f"out {k}"] for k, _ in q.named}
        # which outputs are read is not part of the group itself, but of the block around it
        use = next(ids)
        return _Block({use: ("group", n.key[1], n.key[2], keys)}, [], {k: ("@", use, repr(e)) for k, e in outs.items()})
    if isinstance(q, (A.LeftAnti, A.RightAnti, A.Semi, A.LeftOuter)):
        l, r = (q.right, q.left) if isinstance(q, A.RightAnti) else (q.left, q.right)
        left, right = _block(l, columns, ids), _block(r, columns, ids)
        ln, rn = _seal(left), _seal(right)
        env = {**{n: ("@", "L", repr(e)) for n, e in ln.outputs.items()}, **{n: ("@", "R", repr(e)) for n, e in rn.outputs.items()}}
        on = tuple(sorted({_ordered(c) for c in _conj(q.p, env)}, key=repr))
        kind = {"Semi": "semi", "LeftOuter": "outer"}.get(type(q).__name__, "anti")
        use = next(ids)
        out = {n: ("@", use, f"L{e!r}") for n, e in ln.outputs.items()}
        if kind == "outer":
            out |= {n: ("@", use, f"R{e!r}") for n, e in rn.outputs.items()}
        return _Block({use: (kind, ln.key, rn.key, on)}, [], out)
    if isinstance(q, A.Union):
        ln, rn = normal(q.left, columns), normal(q.right, columns)
        pairing = tuple((repr(e), repr(rn.outputs.get(n))) for n, e in ln.outputs.items())
        return _opaque(("union", ln.key, rn.key, pairing), ln, ids)
    inner = normal(q.child, columns)
    if isinstance(q, A.Distinct):
        # a set of rows: the order and names of columns do not count, nor a column that is given twice
        return _opaque(("distinct", inner.key[:3], tuple(sorted(set(inner.outputs.values()), key=repr))), inner, ids)
    if isinstance(q, A.Sort):
        return _opaque(("sort", inner.key, tuple((_expr(k, inner.outputs), d) for k, d in q.keys)), inner, ids)
    return _opaque((type(q).__name__.lower(), q.n, inner.key), inner, ids)


def normal(q: A.Query, columns: dict[str, tuple[str, ...]]) -> Normal:
    """The normal form of a query; ``columns``: those of each base table."""
    return _seal(_block(q, columns, count()))
