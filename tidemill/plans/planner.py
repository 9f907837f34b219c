"""The planner: what to keep, evict or rebuild, over a graph of all relations seen so far.

Nodes are normal forms; recipes make a node from others, forwards, by an
inverse operator, or from a kept join that it contains.  Costs count pages: a
relation at hand costs its pages, one that is made costs what its inputs cost
and its own pages, as all steps run in one go; what is kept is written at ten
times its pages.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reverse
from . import algebra as A
from .blocks import Block, block, contained, make
from .keys import Shape, expose_keys, recoverable, shape
from .normal import Normal, normal
from .store import Store

WRITE_COST = 10
#: Queries whose cost counts for what to keep.
HISTORY = 8
#: Sets of relations to evict that are looked at before the best one so far is taken.
MOST_STEPS = 2000


@dataclass(frozen=True)
class Recipe:
    """How to make a node: ``make`` gets the inputs' frames, under the names of their queries."""

    kind: str
    inputs: tuple
    make: Callable[[list[DataFrame]], DataFrame]


@dataclass
class Node:
    query: A.Query
    normal: Normal
    recipes: list[Recipe] = field(default_factory=list)
    block: Block | None = None


class Planner:
    """Relations, recipes and the store that they share."""

    def __init__(self, store: Store, tables: dict[str, DataFrame], shapes: dict[str, Shape]):
        self.store, self.tables, self.shapes = store, dict(tables), dict(shapes)
        self.columns = {n: tuple(d.columns) for n, d in tables.items()}
        self.nodes: dict[tuple, Node] = {}
        self.history: deque = deque(maxlen=HISTORY)
        self.measured: dict[A.Query, Shape] = {}
        self._normals: dict[A.Query, Normal] = {}
        self.table_pages: dict[str, int] = {}
        self.trace: list[str] = []

    def normal(self, q: A.Query) -> Normal:
        if q not in self._normals:
            self._normals[q] = normal(q, self.columns)
        return self._normals[q]

    def key(self, q: A.Query) -> tuple:
        return self.normal(q).key

    def has(self, key: tuple) -> bool:
        """Whether a node is at hand: materialized, or a base table."""
        node = self.nodes.get(key)
        return key in self.store.entries or (node is not None and isinstance(node.query, A.Rel) and node.query.name in self.tables)

    def add(self, q: A.Query) -> tuple:
        """Put a query, its inputs and the complements of its operators in the graph."""
        n = self.normal(q)
        if n.key in self.nodes:
            return n.key
        self._insert(q, n)
        if not isinstance(q, A.Rel):
            kids = A.children(q)
            self._complements(q, n.key, kids, tuple(self.key(c) for c in kids))
        return n.key

    def _insert(self, q: A.Query, n: Normal) -> None:
        while same := [c for c in A.children(q) if self.key(c) == n.key]:
            q = same[0]  # renaming makes no node of its own
        n = self.normal(q)
        node = self.nodes[n.key] = Node(q, n)
        if isinstance(q, A.Rel):
            return
        if isinstance(q, (A.Select, A.Project, A.Join, A.Product)):
            node.block = block(q, self.normal)
        kids = A.children(q)
        keys = tuple(self.add(c) for c in kids)
        node.recipes.append(Recipe("forward", keys, lambda dfs: A.lower(q, dict(zip(kids, dfs, strict=True)).get)))
        for k in self.store.entries:
            self._serve(k, n.key)

    def _serve(self, kept: tuple, key: tuple) -> None:
        """If a kept join is contained in a node, give the node a recipe that starts from it."""
        view, node = self.nodes.get(kept), self.nodes[key]
        if kept == key or view is None or view.block is None or node.block is None or any(r.kind == "view" and r.inputs[0] == kept for r in node.recipes):
            return
        if (use := contained(view.block, node.block)) is not None:
            rest = tuple(self.add(node.block.leaves[i][0]) for i in use.rest)
            node.recipes.append(Recipe("view", (kept, *rest), lambda dfs: make(use, dfs[0], dfs[1:])))

    def _side(self, q: A.Query) -> tuple:
        """Add a complement without its own inverses."""
        n = self.normal(q)
        if n.key not in self.nodes:
            self._insert(q, n)
        return n.key

    def complements(self, q: A.Query) -> list[A.Query]:
        """What together with a query's result gives its inputs back; none for what cannot be undone."""
        if not reverse.REVERSIBLE.get(type(q).__name__.lower(), False):
            return []
        if isinstance(q, A.Select):
            return [A.Select(other(q.p), q.child)]
        if isinstance(q, (A.Limit, A.Drop)) and q.n >= 0 and self._total_order(q.child):
            return [A.Drop(q.n, q.child) if isinstance(q, A.Limit) else A.Limit(q.n, q.child)]
        if isinstance(q, A.Project):
            s = shape(q.child, self.shapes)
            out = recoverable(q.named, s.columns)
            key = next((k for k in s.keys if all(c in out for c in k)), None)
            if key:
                lost = [c for c in s.columns if c not in out or c in key]
                # a complement that is the whole input would undo nothing
                return [A.Project(tuple((c, A.Col(c)) for c in lost), q.child)] if len(lost) < len(s.columns) else []
        if isinstance(q, A.Join):
            return [A.LeftAnti(q.p, q.left, q.right), A.RightAnti(q.p, q.left, q.right)]
        return []

    def _total_order(self, q: A.Query) -> bool:
        if not isinstance(q, A.Sort):
            return False
        by = {k.name for k, _ in q.keys if isinstance(k, A.Col)}
        return any(k <= by for k in shape(q.child, self.shapes).keys)

    def _complements(self, q: A.Query, key: tuple, kids: tuple, keys: tuple) -> None:
        sides = self.complements(q)
        if not sides:
            return
        side_keys = [self._side(s) for s in sides]
        parent = [self.nodes[k] for k in keys]
        if isinstance(q, A.Join):
            for i, side in enumerate(side_keys):
                s = shape(kids[i], self.shapes)
                if s.keys:
                    parent[i].recipes.append(Recipe("reverse", (key, side), lambda d, s=s: reverse.unjoin(d[0], d[1], list(s.columns), sorted(s.keys[0]))))
        elif isinstance(q, A.Project):
            s = shape(q.child, self.shapes)
            out = recoverable(q.named, s.columns)
            k = sorted(next(k for k in s.keys if all(c in out for c in k)))

            def back(d, s=s, out=out, k=k):
                given = d[0].select(*(A.column(e).alias(c) for c, e in out.items()))
                return reverse.unproject(given, d[1], k, {c: F.col(c) for c in out}, list(s.columns))

            parent[0].recipes.append(Recipe("reverse", (key, side_keys[0]), back))
        else:
            parent[0].recipes.append(Recipe("reverse", (key, side_keys[0]), lambda d: d[0].unionByName(d[1])))

    def can_rebuild(self, key: tuple, without: frozenset = frozenset(), path: frozenset = frozenset()) -> bool:
        """Whether a node can be made from what is at hand less ``without``; cycles do not count."""
        if key not in without and self.has(key):
            return True
        if key in path or key not in self.nodes:
            return False
        path = path | {key}
        return any(all(self.can_rebuild(i, without, path) for i in r.inputs) for r in self.nodes[key].recipes)

    def size(self, key: tuple) -> int:
        """Pages of a node: those of its files, else as estimated from what was measured so far."""
        if key in self.store.entries:
            return self.store.entries[key].pages
        q = self.nodes[key].query
        if isinstance(q, A.Rel) and q.name in self.table_pages:
            return self.table_pages[q.name]
        return max(1, shape(q, self.shapes, self.measured).pages)

    def costs(self, without: frozenset = frozenset()) -> tuple[dict[tuple, float], dict[tuple, Recipe]]:
        """The least cost of having each node that can be made, and the recipe, by a shortest-path search over the graph."""
        users: dict[tuple, list[tuple[tuple, Recipe]]] = {}
        missing: dict[int, int] = {}
        for k, node in self.nodes.items():
            for r in node.recipes:
                missing[id(r)] = len(set(r.inputs))
                for i in set(r.inputs):
                    users.setdefault(i, []).append((k, r))
        cost: dict[tuple, float] = {}
        how: dict[tuple, Recipe] = {}
        queue = [(float(self.size(k)), n, k, None) for n, k in enumerate(self.nodes) if k not in without and self.has(k)]
        heapq.heapify(queue)
        tick = len(queue)
        while queue:
            c, _, k, r = heapq.heappop(queue)
            if k in cost:
                continue
            cost[k] = c
            if r is not None:
                how[k] = r
            for user, recipe in users.get(k, ()):
                missing[id(recipe)] -= 1
                if not missing[id(recipe)] and user not in cost:
                    tick += 1
                    heapq.heappush(queue, (sum(cost[i] for i in set(recipe.inputs)) + self.size(user), tick, user, recipe))
        return cost, how

    def frame(self, key: tuple, used: list | None = None) -> DataFrame:
        """The relation under its node's own column names, by the cheapest recipes; what is at hand is read."""
        _, how = self.costs()
        return self._frame(key, how, used if used is not None else [])

    def _frame(self, key: tuple, how: dict, used: list) -> DataFrame:
        node = self.nodes[key]
        if key in self.store.entries:
            used.append(("read", key))
            df, entry = self.store.read(key), self.store.entries[key]
            return df.select(*(F.col(entry.columns[e]).alias(n) for n, e in node.normal.outputs.items()))
        if isinstance(node.query, A.Rel) and node.query.name in self.tables:
            used.append(("base", key))
            return self.tables[node.query.name]
        if key not in how:
            raise ValueError("the relation can be rebuilt from nothing that is left")
        recipe = how[key]
        used.append((recipe.kind, key))
        return recipe.make([self._as(i, q, how, used) for i, q in zip(recipe.inputs, self._queries(key, recipe), strict=True)])

    def _queries(self, key: tuple, recipe: Recipe) -> list[A.Query | None]:
        if recipe.kind == "view":
            return [self.nodes[k].query for k in recipe.inputs]
        return list(A.children(self.nodes[key].query)) if recipe.kind == "forward" else [None] * len(recipe.inputs)

    def _as(self, key: tuple, q: A.Query | None, how: dict, used: list) -> DataFrame:
        """An input under the names that its user knows: nodes with other names may stand for it."""
        df = self._frame(key, how, used)
        if q is None:
            return df
        mine, theirs = self.normal(q).outputs, self.nodes[key].normal.outputs
        if list(mine.items()) == list(theirs.items()):
            return df
        by = {e: n for n, e in theirs.items()}
        return df.select(*(F.col(by[e]).alias(n) for n, e in mine.items()))

    def result(self, q: A.Query, used: list | None = None) -> DataFrame:
        """A query's result under its own names."""
        key = self.add(q)
        _, how = self.costs()
        return self._as(key, q, how, used if used is not None else [])

    def pages_of(self, used: list) -> int:
        """Pages that the steps of a plan read, of kept relations and of base tables."""
        return sum(self.size(k) for kind, k in used if kind in ("read", "base"))

    def history_cost(self, without: frozenset) -> float:
        """What the last queries would cost with ``without`` gone, later ones counting more; what cannot be made counts most."""
        cost, _ = self.costs(without)
        return sum(cost.get(k, 1e18) * (1 + i / HISTORY) for i, k in enumerate(self.history))

    def victims(self, over: int, key: tuple | None = None) -> list | None:
        """The relations to give up so that ``over`` pages are freed and the last queries cost least; None if there are none.

        With ``key``, a relation that is new, also None if they would cost
        no less with it and without the victims than without it.  Best first:
        a larger set never costs less, so the first that frees enough is best.
        """
        free = sorted((k for k, e in self.store.entries.items() if not e.pins and k != key), key=lambda k: -self.store.entries[k].pages)
        if sum(self.store.entries[k].pages for k in free) < over:
            return None
        lost = [k for k, n in self.nodes.items() if isinstance(n.query, A.Rel) and not self.has(k)]
        limit = self.history_cost(frozenset([key])) if key is not None else float("inf")
        queue, tick = [(self.history_cost(frozenset()), 0, 0, 0, frozenset())], 0
        while queue:
            cost, _, freed, at, gone = heapq.heappop(queue)
            if freed <= -over:
                return sorted(gone, key=free.index) if cost < limit else None
            if cost >= limit:
                return None
            for i in range(at, len(free)):
                more = gone | {free[i]}
                if all(self.can_rebuild(k, more) for k in [*more, *lost]):
                    tick += 1
                    heapq.heappush(queue, (self.history_cost(more), freed - self.store.entries[free[i]].pages, freed - self.store.entries[free[i]].pages, i + 1, more))
            if tick > MOST_STEPS:  # go on from the cheapest of those that free most
                queue = [min(queue, key=lambda x: (x[2], x[0]))]
        return None

    def evict(self, keys: list) -> None:
        for k in keys:
            self.trace.append(f"evict {self.store.entries[k].pages} pages")
            self.store.delete(k)

    def make_room(self, need: int) -> bool:
        """Evict until ``need`` more pages fit; if that is not possible nothing is evicted."""
        over = 0 if self.store.budget is None else self.store.used + need - self.store.budget
        if over <= 0:
            return True
        gone = self.victims(over)
        self.evict(gone or [])
        return gone is not None

    def _keep(self, key: tuple, df: DataFrame) -> bool:
        """Write a relation and keep it if it fits, or if it is worth more than what must go for it; else it goes and nothing else does."""
        node = self.nodes[key]
        entry = self.store.put(key, df, {e: n for n, e in node.normal.outputs.items()})
        known = shape(node.query, self.shapes)
        self.measured[node.query] = Shape(known.columns, known.keys, entry.rows, entry.pages * 4096 / max(1, entry.rows))
        if self.store.over:
            gone = self.victims(self.store.over, key)
            if gone is None:
                self.store.delete(key)
                return False
            self.evict(gone)
        for k in self.nodes:
            self._serve(key, k)
        return True

    def may_fit(self, key: tuple) -> bool:
        """Whether the size leaves a chance in the budget less what is pinned; a guess gets the benefit of its uncertainty."""
        if self.store.budget is None:
            return True
        s = shape(self.nodes[key].query, self.shapes, self.measured)
        pinned = sum(e.pages for e in self.store.entries.values() if e.pins)
        return s.pages * min(1.0, s.sure) <= self.store.budget - pinned and self.store.budget > 0

    def materialize(self, q: A.Query, complements: bool = False) -> tuple[bool, list]:
        """Keep a query's result if the budget allows; with ``complements`` also what makes it reversible, where that fits without giving anything up.

        Gives whether it is kept and the steps that made it.  Nothing is
        written that cannot fit, and nothing evicted before it is known what
        was written.
        """
        if complements:
            q = self.reversible(q)
        key, used = self.add(q), []
        self.history.append(key)
        if key in self.store.entries:
            return True, [("read", key)]
        if not self.may_fit(key):
            return False, used
        df = self.frame(key, used)
        pinned = {k for kind, k in used if kind == "read"}
        for k in pinned:
            self.store.entries[k].pins += 1
        try:
            kept = self._keep(key, df)
            if kept and complements:
                self.store.entries[key].pins += 1
                pinned.add(key)
                for side in self.complements(q):
                    k = self._side(side)
                    room = None if self.store.budget is None else self.store.budget - self.store.used
                    if k not in self.store.entries and (room is None or self.size(k) <= room):
                        self._keep(k, self.frame(k))
            return kept, used
        finally:
            for k in pinned:
                self.store.entries[k].pins -= 1

    def reversible(self, q: A.Query) -> A.Query:
        """A projection or group with the keys that it would lose, so that its input can be told apart again; any other query as it is."""
        return expose_keys(q, self.shapes) if isinstance(q, (A.Project, A.Group)) else q

    def forget(self, name: str) -> None:
        """Give up everything that was made from a table: it is another one now."""
        for key in [k for k, n in self.nodes.items() if name in A.leaves(n.query)]:
            if key in self.store.entries:
                self.store.entries[key].pins = 0
                self.store.delete(key)
        gone = {k for k, n in self.nodes.items() if name in A.leaves(n.query)}
        self.nodes = {k: n for k, n in self.nodes.items() if k not in gone}
        for n in self.nodes.values():
            n.recipes = [r for r in n.recipes if not gone & set(r.inputs)]
        self.history = deque((k for k in self.history if k not in gone), maxlen=HISTORY)
        self.measured = {q: m for q, m in self.measured.items() if name not in A.leaves(q)}
        self._normals = {q: n for q, n in self._normals.items() if name not in A.leaves(q)}

    def forget_table(self, name: str) -> None:
        """Give up a base table that can be rebuilt from what is kept."""
        key = self.add(A.Rel(name))
        if not self.can_rebuild(key, frozenset([key])):
            raise ValueError(f"{name} cannot be rebuilt")
        del self.tables[name]

    def graph(self) -> str:
        """All nodes and recipes as a graph in the DOT language; what is at hand is filled."""
        ids = {k: f"n{i}" for i, k in enumerate(self.nodes)}
        lines = ["digraph relations {"]
        for k, node in self.nodes.items():
            name = node.query.name if isinstance(node.query, A.Rel) else type(node.query).__name__
            lines.append(f'  {ids[k]} [label="{name}, {self.size(k)} pages"{", style=filled" if self.has(k) else ""}];')
            lines += [f'  {ids[i]} -> {ids[k]} [label="{r.kind}"];' for r in node.recipes for i in r.inputs if i in ids]
        return "\n".join([*lines, "}"])

    def explain(self, q: A.Query) -> str:
        """The recipes that would make a query, as an indented text."""
        key = self.add(q)
        cost, how = self.costs()
        lines = []

        def walk(k: tuple, depth: int) -> None:
            node = self.nodes[k]
            what = "read" if k in self.store.entries else "table" if self.has(k) else how[k].kind if k in how else "?"
            lines.append(f"{'  ' * depth}{what} {type(node.query).__name__}{' ' + node.query.name if isinstance(node.query, A.Rel) else ''} ({self.size(k)} pages, cost {cost.get(k, float('inf')):.0f})")
            if not self.has(k) and k in how:
                for i in how[k].inputs:
                    walk(i, depth + 1)

        walk(key, 0)
        return "\n".join(lines)


def other(p: A.Expr) -> A.Expr:
    """A predicate that holds where ``p`` does not, nulls included."""
    return A.Call("case", (p, A.Lit(False), A.Lit(True)))

