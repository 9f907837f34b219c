"""The query algebra: immutable trees that lower to DataFrames.

Columns carry their table's prefix, so names are unique in a query; a table
that is used twice goes through ``alias``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


class Expr:
    """Operators build calls; ``eq`` and ``ne`` compare, as ``==`` is structural."""

    def __add__(self, o):
        return Call("+", (self, lift(o)))

    def __sub__(self, o):
        return Call("-", (self, lift(o)))

    def __mul__(self, o):
        return Call("*", (self, lift(o)))

    def __truediv__(self, o):
        return Call("/", (self, lift(o)))

    def __neg__(self):
        return Call("neg", (self,))

    def __lt__(self, o):
        return Call("<", (self, lift(o)))

    def __le__(self, o):
        return Call("<=", (self, lift(o)))

    def __gt__(self, o):
        return Call("<", (lift(o), self))

    def __ge__(self, o):
        return Call("<=", (lift(o), self))

    def __and__(self, o):
        return Call("and", (self, o))

    def __or__(self, o):
        return Call("or", (self, o))

    def __invert__(self):
        return Call("not", (self,))

    def eq(self, o):
        return Call("=", (self, lift(o)))

    def ne(self, o):
        return Call("not", (Call("=", (self, lift(o))),))

    def like(self, pattern: str):
        return Call("like", (self, Lit(pattern)))

    def between(self, a, b):
        return (self >= a) & (self <= b)

    def isin(self, *values):
        return reduce(lambda x, y: x | y, [self.eq(v) for v in values])


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Call(Expr):
    """op is an operator of Expr or one of abs, sign, case (condition, then, else), casewhen (condition, then, ..., else), substring (s, from, for),
    year, month, day, date, interval (date, text), cast (x, type), sql (the text of a constant), or ``call`` and a function's SQL name."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Agg(Expr):
    """fn: sum avg min max count count_distinct first; arg None is ``count(*)``."""

    fn: str
    arg: Expr | None = None


def col(name: str) -> Col:
    return Col(name)


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def fn(op: str, *args) -> Call:
    return Call(op, tuple(lift(a) for a in args))


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "=": lambda a, b: a == b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def column(e: Expr) -> Column:
    """The Spark column of an expression."""
    if isinstance(e, Col):
        return F.col(e.name)
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Agg):
        if e.arg is None:
            return F.count(F.lit(1))
        f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "first": F.first}[e.fn]
        return f(column(e.arg))
    if e.op == "like":
        return scalar.like_column(column(e.args[0]), e.args[1].value)
    if e.op == "substring":
        return scalar.substring(column(e.args[0]), e.args[1].value, e.args[2].value)
    if e.op == "date":
        return F.lit(e.args[0].value).cast("date")
    if e.op == "sql":
        return F.expr(e.args[0].value)
    if e.op == "cast":
        return column(e.args[0]).cast(e.args[1].value)
    if e.op == "interval":
        return (column(e.args[0]) + F.expr(f"INTERVAL {e.args[1].value}")).cast("date")
    a = [column(x) for x in e.args]
    if e.op.startswith("call "):
        return F.call_function(e.op[5:], *a)
    if e.op == "casewhen":
        when = F.when(a[0], a[1])
        for i in range(2, len(a) - 1, 2):
            when = when.when(a[i], a[i + 1])
        return when.otherwise(a[-1]) if len(a) % 2 else when
    if e.op in _BINARY:
        return _BINARY[e.op](*a)
    if e.op in ("year", "month", "day"):
        return scalar.extract(e.op, a[0])
    return {"neg": lambda x: -x, "not": lambda x: ~x, "abs": F.abs, "sign": F.signum, "case": lambda p, x, y: F.when(p, x).otherwise(y)}[e.op](*a)


def columns_of(e: Expr) -> set[str]:
    if isinstance(e, Col):
        return {e.name}
    if isinstance(e, Agg):
        return columns_of(e.arg) if e.arg is not None else set()
    return set().union(*(columns_of(a) for a in e.args)) if isinstance(e, Call) else set()


def replace(e: Expr, by: dict[str, Expr]) -> Expr:
    """The expression with columns replaced."""
    if isinstance(e, Col):
        return by.get(e.name, e)
    if isinstance(e, Agg):
        return Agg(e.fn, None if e.arg is None else replace(e.arg, by))
    return Call(e.op, tuple(replace(a, by) for a in e.args)) if isinstance(e, Call) else e


#: Conjuncts that distributing OR over AND may give; a larger predicate stays as it is.
MOST_CLAUSES = 32


def conjuncts(e: Expr) -> list[Expr]:
    """The predicates whose conjunction is ``e``; what all branches of an OR share is taken out of it."""
    if isinstance(e, Call) and e.op == "and":
        return [c for a in e.args for c in conjuncts(a)]
    if isinstance(e, Call) and e.op == "or":
        branches = [conjuncts(b) for b in disjuncts(e)]
        shared = [c for c in branches[0] if all(c in b for b in branches[1:])]
        if shared:
            rest = [[c for c in b if c not in shared] for b in branches]
            return shared if not all(rest) else [*shared, reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, b) for b in rest])]
    return [e]


def normal_clauses(e: Expr) -> list[Expr]:
    """The clauses of ``e`` in conjunctive normal form: NOT goes to the leaves, OR over AND is distributed up to MOST_CLAUSES."""
    e = _push_not(e, False)
    out = []
    for c in conjuncts(e):
        clauses = [[]]
        for d in disjuncts(c):
            clauses = [x + [y] for x in clauses for y in normal_clauses(d)] if isinstance(d, Call) and d.op == "and" else [x + [d] for x in clauses]
            if len(clauses) > MOST_CLAUSES:
                clauses = [[c]]
                break
        out += [reduce(lambda x, y: x | y, x) for x in clauses]
    return out


def _push_not(e: Expr, no: bool) -> Expr:
    """The same truth where it is true, nulls counting as they do in SQL: De Morgan's laws hold in three values."""
    if isinstance(e, Call) and e.op == "not":
        return _push_not(e.args[0], not no)
    if isinstance(e, Call) and e.op in ("and", "or"):
        op = {"and": "or", "or": "and"}[e.op] if no else e.op
        return Call(op, tuple(_push_not(a, no) for a in e.args))
    return Call("not", (e,)) if no else e


def disjuncts(e: Expr) -> list[Expr]:
    return [d for a in e.args for d in disjuncts(a)] if isinstance(e, Call) and e.op == "or" else [e]


def invert(e: Expr, target: str, result: Expr) -> Expr | None:
    """``target`` in terms of ``result`` = e, where it occurs once under + - * / and neg and can be got back; else None.

    A factor that is zero loses the target, so only literal factors other than 0 are undone.
    """
    if isinstance(e, Col):
        return result if e.name == target else None
    if not isinstance(e, Call) or sum(target in columns_of(a) for a in e.args) != 1:
        return None
    if e.op == "neg":
        return invert(e.args[0], target, -result)
    if e.op not in ("+", "-", "*", "/"):
        return None
    a, b = e.args
    left = target in columns_of(a)
    other = b if left else a
    if e.op in "*/" and not (isinstance(other, Lit) and other.value):
        return None
    if e.op == "+":
        return invert(a if left else b, target, result - other)
    if e.op == "*":
        return invert(a if left else b, target, result / other)
    if e.op == "-":
        return invert(a, target, result + other) if left else invert(b, target, other - result)
    return invert(a, target, result * other) if left else invert(b, target, other / result)


class Query:
    def where(self, p: Expr):
        return Select(p, self)

    def select(self, **named: Expr):
        return Project(tuple(named.items()), self)

    def keep(self, *names: str):
        return Project(tuple((n, Col(n)) for n in names), self)

    def join(self, other, p: Expr):
        return Join(p, self, other)

    def group(self, keys: tuple, **named: Expr):
        return Group(tuple(named.items()), tuple(lift(k) for k in keys), self)


@dataclass(frozen=True)
class Rel(Query):
    name: str


@dataclass(frozen=True)
class Select(Query):
    p: Expr
    child: Query


@dataclass(frozen=True)
class Project(Query):
    named: tuple
    child: Query


@dataclass(frozen=True)
class Product(Query):
    left: Query
    right: Query


@dataclass(frozen=True)
class Join(Query):
    p: Expr
    left: Query
    right: Query


@dataclass(frozen=True)
class LeftOuter(Query):
    p: Expr
    left: Query
    right: Query


@dataclass(frozen=True)
class LeftAnti(Query):
    p: Expr
    left: Query
    right: Query


@dataclass(frozen=True)
class RightAnti(Query):
    p: Expr
    left: Query
    right: Query


@dataclass(frozen=True)
class Semi(Query):
    """Rows of left with a match: the distinct-by-left of the join."""

    p: Expr
    left: Query
    right: Query


@dataclass(frozen=True)
class Union(Query):
    """Bag union with left's columns; what right misses is padded with the type's default."""

    left: Query
    right: Query


@dataclass(frozen=True)
class Distinct(Query):
    child: Query


@dataclass(frozen=True)
class Group(Query):
    named: tuple
    keys: tuple
    child: Query


@dataclass(frozen=True)
class Sort(Query):
    """keys: (expression, descending)."""

    keys: tuple
    child: Query


@dataclass(frozen=True)
class Limit(Query):
    """The first n rows; a negative n is no limit."""

    n: int
    child: Query


@dataclass(frozen=True)
class Drop(Query):
    n: int
    child: Query


def in_query(e: Expr, q: Query, name: str, child: Query) -> Semi:
    """Rows of ``child`` whose ``e`` is a value of ``q``'s column ``name``."""
    return Semi(e.eq(Col(name)), child, q)


def with_scalar(child: Query, q: Query) -> Product:
    """``child`` with the columns of ``q``, a group without keys and so one row: a scalar subquery."""
    if not isinstance(q, Group) or q.keys:
        raise ValueError("a scalar subquery is a group without keys")
    return Product(child, q)


def leaves(q: Query) -> set[str]:
    """The names of the base tables that a query reads."""
    return {q.name} if isinstance(q, Rel) else set().union(*(leaves(c) for c in children(q)))


def alias(q: Query, prefix: str, names: list[str]) -> Project:
    """``q`` as ``prefix``: each column under prefix_name."""
    return Project(tuple((f"{prefix}_{n}", Col(n)) for n in names), q)


def children(q: Query) -> tuple[Query, ...]:
    if isinstance(q, Rel):
        return ()
    return (q.child,) if hasattr(q, "child") else (q.left, q.right)


def lower(q: Query, resolve: Callable[[Query], DataFrame | None]) -> DataFrame:
    """The DataFrame of a query; ``resolve`` gives that of base tables and of whatever it has at hand."""
    from ..operators import relational as r

    if (known := resolve(q)) is not None:
        return known
    if isinstance(q, Rel):
        raise KeyError(f"no table {q.name}")
    c = [lower(x, resolve) for x in children(q)]
    if isinstance(q, Select):
        return r.select(c[0], column(q.p))
    if isinstance(q, Project):
        return r.project(c[0], {n: column(e) for n, e in q.named})
    if isinstance(q, Product):
        return r.product(*c)
    if isinstance(q, Join):
        return r.join(*c, column(q.p))
    if isinstance(q, LeftOuter):
        return r.left_outer(*c, column(q.p))
    if isinstance(q, LeftAnti):
        return r.left_antijoin(*c, column(q.p))
    if isinstance(q, RightAnti):
        return r.right_antijoin(*c, column(q.p))
    if isinstance(q, Semi):
        return r.semi(*c, column(q.p))
    if isinstance(q, Union):
        return r.union(*c)
    if isinstance(q, Distinct):
        return r.distinct_of(c[0], c[0].columns)
    if isinstance(q, Group):
        return r.group(c[0], [column(k) for k in q.keys], {n: column(e) for n, e in q.named}, [k.name if isinstance(k, Col) else None for k in q.keys])
    if isinstance(q, Sort):
        return r.sort(c[0], [column(k).desc() if d else column(k).asc() for k, d in q.keys])
    return r.limit(c[0], q.n) if isinstance(q, Limit) else r.drop(c[0], q.n)
