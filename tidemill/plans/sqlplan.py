"""SQL text to the algebra: Spark parses and resolves a query, its subqueries become joins, and the plan becomes a tree.

``translate`` raises ``Unsupported`` for what the algebra has no node for
(windows, generators, full outer joins and the like).
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame

from . import algebra as A


class Unsupported(Exception):
    """The algebra cannot express a plan."""


#: Spark's rules that turn EXISTS, IN and correlated scalar subqueries into semi, anti and outer joins.
_RULES = ("PullupCorrelatedPredicates", "RewritePredicateSubquery", "RewriteCorrelatedScalarSubquery")
_BINARY = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "And": "and", "Or": "or", "Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/"}
_SWAPPED = {"GreaterThan": "<", "GreaterThanOrEqual": "<="}
_AGGREGATES = {"Sum": "sum", "Average": "avg", "Min": "min", "Max": "max", "Count": "count", "First": "first", "AnyValue": "first"}
#: Functions that a tree calls by their SQL name, and names that differ from what Spark prints.
_NAMES = {"Remainder": "mod", "EqualNullSafe": "equal_null"}
_FUNCTIONS = {"Year", "Month", "DayOfMonth", "Abs", "Signum", "Round", "BRound", "Substring", "Concat", "Coalesce", "IsNull", "IsNotNull", "Upper", "Lower", "StringTrim", "Length", "Contains", "StartsWith", "EndsWith", "Floor", "Ceil", "Remainder", "DateAdd", "DateSub", "DateDiff", "EqualNullSafe", "Left", "Right"}
_LITERALS = {"int": int, "string": str, "boolean": bool, "double": float}


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def analysed(df: DataFrame):
    """The resolved plan of a query, without subquery predicates where they can be joins."""
    plan = df._jdf.queryExecution().analyzed()
    rules = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.optimizer
    for name in _RULES:
        plan = getattr(getattr(rules, f"{name}$"), "MODULE$").apply(plan)
    return plan


def translate(df: DataFrame, tables: dict[str, tuple[str, ...]]) -> tuple[A.Query, list[str]]:
    """(query, names of its columns) for a DataFrame over views; ``tables``: columns of those that are leaves."""
    t = _Translator(tables)
    plan = analysed(df)
    q, env = t.plan(plan)
    out = [env[a.exprId().id()] for a in _list(plan.output())]
    return A.Project(tuple((f"c{i}", A.Col(n)) for i, n in enumerate(out)), q), list(df.columns)


class _Translator:
    """Columns get names that are unique in the whole query; ``env`` maps Spark's expression ids to them."""

    def __init__(self, tables: dict[str, tuple[str, ...]]):
        self.tables, self.used, self.ctes, self.common, self.numbers = tables, set(), {}, {}, count()

    def name(self, hint: str = "x") -> str:
        return f"{hint}__{next(self.numbers)}"

    # plans
    def plan(self, p) -> tuple[A.Query, dict[int, str]]:
        return getattr(self, f"_{_kind(p)}", self._unknown)(p)

    def _unknown(self, p):
        raise Unsupported(_kind(p))

    def _WithCTE(self, p):
        for d in _list(p.cteDefs()):
            self.ctes[d.id()] = d.child()
        return self.plan(p.plan())

    def _CTERelationRef(self, p):
        child = self.ctes[p.cteId()]
        q, env = self.plan(child)
        inner = [env[a.exprId().id()] for a in _list(child.output())]
        return q, {a.exprId().id(): n for a, n in zip(_list(p.output()), inner, strict=True)}

    def _SubqueryAlias(self, p):
        name = p.identifier().name()
        if _kind(p.child()) != "View" or name not in self.tables:
            return self.plan(p.child())
        out = _list(p.child().output())
        if tuple(a.name() for a in out) != self.tables[name]:
            raise Unsupported(f"other columns of {name}")
        if name not in self.used:
            self.used.add(name)
            return A.Rel(name), {a.exprId().id(): a.name() for a in out}
        named = tuple((self.name(a.name()), A.Col(a.name())) for a in out)
        return A.Project(named, A.Rel(name)), {a.exprId().id(): n for a, (n, _) in zip(out, named, strict=True)}

    def _Project(self, p):
        q, env = self.plan(p.child())
        named, out = [], {}
        for e in _list(p.projectList()):
            x, q = self.expr(e, env, q)
            n = x.name if isinstance(x, A.Col) and all(x.name != m for m, _ in named) else self.name()
            named.append((n, x))
            out[e.exprId().id()] = n
        return A.Project(tuple(named), q), out

    def _Filter(self, p):
        q, env = self.plan(p.child())
        c, q = self.expr(p.condition(), env, q)
        return A.Select(c, q), env

    def _Join(self, p):
        (left, le), (right, re) = self.plan(p.left()), self.plan(p.right())
        env, kind = {**le, **re}, p.joinType().toString()
        if p.condition().isDefined():
            c, both = self.expr(p.condition().get(), env, None)
            if both is not None:
                raise Unsupported("subquery in a join")
        elif kind in ("Inner", "Cross"):
            return A.Product(left, right), env
        else:
            c = A.Lit(True)
        if kind == "RightOuter":
            return A.LeftOuter(c, right, left), env
        node = {"Inner": A.Join, "Cross": A.Join, "LeftOuter": A.LeftOuter, "LeftSemi": A.Semi, "LeftAnti": A.LeftAnti}.get(kind)
        if node is None:
            raise Unsupported(kind)
        return node(c, left, right), le if node in (A.Semi, A.LeftAnti) else env

    def _Aggregate(self, p):
        q, env = self.plan(p.child())
        keys: dict[A.Expr, str] = {}
        for e in _list(p.groupingExpressions()):
            x, q = self.expr(e, env, q)
            if x not in keys:
                keys[x] = x.name if isinstance(x, A.Col) else self.name("key")
        outs = []
        for e in _list(p.aggregateExpressions()):
            x, q = self.expr(e, env, q)
            outs.append((e.exprId().id(), x))
        made = [(n, x) for x, n in keys.items() if not isinstance(x, A.Col)]
        if made:  # keys that are expressions become columns first
            needed = sorted({c for _, x in outs for c in A.columns_of(x)} | {x.name for x in keys if isinstance(x, A.Col)})
            q = A.Project((*((c, A.Col(c)) for c in needed), *made), q)
        aggs: dict[A.Agg, str] = {}

        def parts(x: A.Expr) -> A.Expr:
            if x in keys:
                return A.Col(keys[x])
            if isinstance(x, A.Agg):
                return A.Col(aggs.setdefault(x, self.name("agg")))
            if isinstance(x, A.Col):
                raise Unsupported(f"{x.name} is no key")
            return A.Call(x.op, tuple(parts(a) for a in x.args)) if isinstance(x, A.Call) else x

        outer = [(i, parts(x)) for i, x in outs]
        group = A.Group((*((n, A.Col(n)) for n in keys.values()), *((n, x) for x, n in aggs.items())), tuple(A.Col(n) for n in keys.values()), q)
        named, out = [], {}
        for i, x in outer:
            n = x.name if isinstance(x, A.Col) and all(x.name != m for m, _ in named) else self.name()
            named.append((n, x))
            out[i] = n
        return A.Project(tuple(named), group), out

    def _Distinct(self, p):
        q, env = self.plan(p.child())
        return A.Distinct(q), env

    def _Sort(self, p):
        q, env = self.plan(p.child())
        keys = []
        for o in _list(p.order()):
            down = o.direction().toString() == "Descending"
            if o.nullOrdering().toString() != ("NullsLast" if down else "NullsFirst"):
                raise Unsupported("order of nulls")
            x, q = self.expr(o.child(), env, q)
            keys.append((x, down))
        return A.Sort(tuple(keys), q), env

    def _GlobalLimit(self, p):
        inner = p.child()
        q, env = self.plan(inner.child() if _kind(inner) == "LocalLimit" else inner)
        return A.Limit(int(p.limitExpr().toString()), q), env

    def _Offset(self, p):
        q, env = self.plan(p.child())
        return A.Drop(int(p.offsetExpr().toString()), q), env

    def _Union(self, p):
        kids = _list(p.children())
        names = [self.name(a.name()) for a in _list(p.output())]
        sides = []
        for k in kids:
            q, env = self.plan(k)
            sides.append(A.Project(tuple((n, A.Col(env[a.exprId().id()])) for n, a in zip(names, _list(k.output()), strict=True)), q))
        return reduce(A.Union, sides), {a.exprId().id(): n for a, n in zip(_list(p.output()), names, strict=True)}

    # expressions
    def expr(self, e, env: dict[int, str], q: A.Query | None) -> tuple[A.Expr, A.Query | None]:
        """The expression, and ``q`` with the rows of scalar subqueries that it asks for."""
        kind = _kind(e)
        if kind == "With":  # an expression that is named as it is used more than once
            for d in _list(e.defs()):
                self.common[d.id().toString()], q = self.expr(d.child(), env, q)
            return self.expr(e.child(), env, q)
        if kind == "Between":
            return self.expr(e.replacement(), env, q)
        if kind == "CommonExpressionRef":
            return self.common[e.id().toString()], q
        if kind == "ScalarSubquery":
            if e.children().size():
                raise Unsupported("correlated subquery")
            plan = e.plan()
            sub, inner = self.plan(plan)
            if not _one_row(sub):
                raise Unsupported("subquery of several rows")
            name = inner[_list(plan.output())[0].exprId().id()]
            one = self.name("scalar")
            sub = A.Project(((one, A.Col(name)),), sub)
            return A.Col(one), sub if q is None else A.Product(q, sub)
        if kind == "AttributeReference":
            if e.exprId().id() not in env:
                raise Unsupported(f"outer column {e.name()}")
            return A.Col(env[e.exprId().id()]), q
        if kind == "Alias":
            return self.expr(e.child(), env, q)
        if kind == "AggregateExpression":
            f = e.aggregateFunction()
            if e.filter().isDefined() or _kind(f) not in _AGGREGATES:
                raise Unsupported(f.toString())
            args = []
            for a in _list(f.children()):
                x, q = self.expr(a, env, q)
                args.append(x)
            name = _AGGREGATES[_kind(f)]
            if e.isDistinct() and name not in ("min", "max"):
                if name != "count" or len(args) != 1:
                    raise Unsupported("distinct aggregate")
                name = "count_distinct"
            if name == "count" and len(args) == 1 and isinstance(args[0], A.Lit) and args[0].value is not None:
                return A.Agg("count"), q
            if len(args) != 1:
                raise Unsupported(f.toString())
            return A.Agg(name, args[0]), q
        if kind == "Literal":
            of = _LITERALS.get(e.dataType().simpleString())
            if of is None or e.value() is None:
                return A.Call("sql", (A.Lit(e.sql()),)), q
            return A.Lit(of(e.value().toString() if of is str else e.value())), q
        if e.foldable() and e.dataType().simpleString() == "date":
            days = e.eval(None)  # since 1970
            return A.Call("sql", (A.Lit("CAST(NULL AS DATE)" if days is None else f"DATE '{date(1970, 1, 1) + timedelta(days)}'"),)), q
        args = []
        for a in _list(e.children()):
            x, q = self.expr(a, env, q)
            args.append(x)
        if kind in _BINARY:
            return A.Call(_BINARY[kind], tuple(args)), q
        if kind in _SWAPPED:
            return A.Call(_SWAPPED[kind], (args[1], args[0])), q
        if kind == "Not":
            return A.Call("not", (args[0],)), q
        if kind == "UnaryMinus":
            return A.Call("neg", (args[0],)), q
        if kind == "Cast":
            return A.Call("cast", (args[0], A.Lit(e.dataType().sql()))), q
        if kind == "In":
            return reduce(lambda x, y: A.Call("or", (x, y)), [A.Call("=", (args[0], x)) for x in args[1:]]), q
        if kind == "If":
            return A.Call("case", tuple(args)), q
        if kind == "CaseWhen":
            return A.Call("casewhen", tuple(args)), q
        if kind == "Like" and isinstance(args[1], A.Lit):
            return A.Call("like", tuple(args[:2])), q
        if kind in _FUNCTIONS:
            return A.Call(f"call {_NAMES.get(kind) or e.prettyName()}", tuple(args)), q
        raise Unsupported(kind)


def _one_row(q: A.Query) -> bool:
    """Whether a query has one row whatever its tables: a group without keys, projected."""
    while isinstance(q, A.Project):
        q = q.child
    return isinstance(q, A.Group) and not q.keys
