"""Sessions: workloads of queries that share what they materialize."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import algebra as A
from .keys import Shape
from .planner import WRITE_COST, Planner
from .sqlplan import Unsupported, translate
from .store import Store


@dataclass
class Report:
    """What a query did: joins that ran, pages, relations reused, rebuilt and evicted; reused says that its result was there."""

    rows: int
    kept: bool
    reused: bool
    views: int
    joins: int
    rebuilt: int
    pages_read: int
    pages_written: int
    evicted: int

    @property
    def cost(self) -> int:
        return self.pages_read + WRITE_COST * self.pages_written


class Session:
    """SQL and algebra over registered tables, with one store for all queries."""

    def __init__(self, spark: SparkSession, root: str, budget: int | None = None):
        self.spark = spark
        self.store = Store(spark, root, budget)
        self.planner = Planner(self.store, {}, {})
        self._trees: dict[str, tuple[A.Query, list[str]]] = {}

    def register(self, name: str, df: DataFrame, keys: tuple = (), rows: float | None = None) -> None:
        """A base table; ``keys``: tuples of columns that are unique. Rows are counted where not given.

        What was made from an earlier table of that name is given up.
        """
        p = self.planner
        self._trees.clear()
        if name in p.columns:
            p.forget(name)
        df.createOrReplaceTempView(name)
        n = df.count() if rows is None else rows
        width = {"string": 16.0, "double": 8.0, "bigint": 8.0, "int": 4.0, "date": 4.0}
        size, known = sum(width.get(t, 8.0) for _, t in df.dtypes), self.store.file_pages(df)
        p.tables[name], p.columns[name] = df, tuple(df.columns)
        p.table_pages.pop(name, None)
        if known:
            size = known * 4096 / max(1, n)
            p.table_pages[name] = known
        p.shapes[name] = Shape(tuple(df.columns), tuple(frozenset(k) for k in keys), n, size)

    def tree(self, text: str) -> tuple[A.Query, list[str]]:
        """SQL text as a query and the names of its columns; a text is parsed once."""
        if text not in self._trees:
            for name, df in self.planner.tables.items():
                df.createOrReplaceTempView(name)
            self._trees[text] = translate(self.spark.sql(text), self.planner.columns)
        return self._trees[text]

    def sql(self, text: str, keep: bool = False) -> DataFrame:
        """A SQL query through the planner, kept like any other; what the algebra cannot express runs as it is."""
        try:
            q, names = self.tree(text)
        except Unsupported:
            return self.spark.sql(text)
        if keep:
            self.planner.materialize(q)
        return self.query(q).toDF(*names)

    def query(self, q: A.Query) -> DataFrame:
        return self.planner.result(q)

    def run(self, queries: list[A.Query | str], complements: bool = False) -> list[Report]:
        """Run a workload of trees and SQL texts in order, keeping each result that is worth it."""
        return [self.step(q, complements)[0] for q in queries]

    def step(self, query: A.Query | str, complements: bool = False) -> tuple[Report, DataFrame]:
        """Run a query: what it did, and its result."""
        q, names = self.tree(query) if isinstance(query, str) else (query, None)
        s, p = self.store, self.planner
        written, gone = s.written_pages, s.deleted
        kept, used = p.materialize(q, complements)
        steps: list = []
        df = p.result(q, steps)
        read = p.pages_of(used) + p.pages_of(steps) if kept and used[:1] != [("read", p.key(q))] else p.pages_of(steps)
        did = used or steps
        joins = sum(isinstance(p.nodes[k].query, (A.Join, A.Product)) for kind, k in did if kind == "forward")
        count = lambda kind: sum(x == kind for x, _ in did)
        rows = s.entries[p.key(q)].rows if p.key(q) in s.entries else df.count()
        out = Report(rows, kept, used[:1] == [("read", p.key(q))], count("view"), joins, count("reverse"), read, s.written_pages - written, s.deleted - gone)
        return out, df if names is None else df.toDF(*names)


def star_workload(hub: str, spokes: list[str], size: int, n: int) -> list[A.Query]:
    """``n`` star joins of a hub and ``size`` - 1 spokes; each next one exchanges the spoke in the middle.

    Table t has the key ``t_id`` and, for each neighbour u, a column ``t_u``.
    """
    chosen, nxt, out = spokes[: size - 1], size - 1, []
    for _ in range(n):
        q: A.Query = A.Rel(hub)
        for t in chosen:
            q = A.Join(A.col(f"{hub}_{t}").eq(A.col(f"{t}_{hub}")), q, A.Rel(t))
        out.append(q)
        chosen = list(chosen)
        chosen[len(chosen) // 2] = spokes[nxt % len(spokes)]
        nxt += 1
        while len(set(chosen)) < len(chosen):
            chosen[len(chosen) // 2] = spokes[nxt % len(spokes)]
            nxt += 1
    return out


def find_min_budget(solvable, low: int = 1, steps: int = 5) -> int | None:
    """The smallest budget found by doubling ``low`` up to ``steps`` times, then halving the gap as often."""
    high = low
    for _ in range(steps):
        if solvable(high):
            break
        high *= 2
    else:
        return None
    bad = high // 2
    for _ in range(steps):
        if high - bad <= 1:
            break
        middle = (bad + high) // 2
        if solvable(middle):
            high = middle
        else:
            bad = middle
    return high

