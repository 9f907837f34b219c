"""Operators with complementary outputs, and the inverses that rebuild a lost input.

==========  =================================  ===========================
forward     outputs                            inverse
==========  =================================  ===========================
split       matching rows, all others          unsplit (bag union)
split_limit first n rows, the rest             unlimit (bag union)
split_project  projection, key and lost columns  unproject (join on the key)
join3       join, left and right antijoin      unjoin_left, unjoin_right
==========  =================================  ===========================

Group and sort have no inverse.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whether an operator's input can be rebuilt from its outputs; the planner asks for complements of these only.
REVERSIBLE = {"select": True, "project": True, "limit": True, "drop": True, "union": True, "product": True, "join": True, "group": False, "distinct": False, "sort": False}


class JoinOutputs(NamedTuple):
    join: DataFrame
    left_anti: DataFrame
    right_anti: DataFrame


def split(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that match and all others, those for which ``p`` is null among them."""
    holds = F.coalesce(p, F.lit(False))
    return df.filter(p), df.filter(~holds)


def unsplit(match: DataFrame, rest: DataFrame) -> DataFrame:
    return match.unionByName(rest)


def split_limit(df: DataFrame, order: list[Column], key: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows by ``order`` then ``key``, and the rest, unordered.

    ``key`` makes the order total, without which the parts could overlap. The
    first part is a top-n; the rest is an antijoin with its keys, so nothing
    is sorted as a whole.
    """
    if not key:
        raise ValueError("a limit that can be undone needs a unique key in its order")
    total = [*order, *(F.col(k).asc() for k in key)]
    first = df.orderBy(*total).limit(n)
    return first, _without(df, first, key)


def _without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    g = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in key))
    on = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key]
    return df.join(g, on, "left_anti")


def unlimit(first: DataFrame, rest: DataFrame) -> DataFrame:
    return first.unionByName(rest)


def split_project(df: DataFrame, named: dict[str, Column], recoverable: set[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The projection with the key, and the complement: key and the columns that the projection loses.

    ``recoverable``: columns that the projection's outputs give back.
    """
    proj = {**{k: F.col(k) for k in key}, **named}
    lost = [c for c in df.columns if c not in recoverable and c not in key]
    return df.select(*(c.alias(n) for n, c in proj.items())), df.select(*key, *lost)


def unproject(proj: DataFrame, complement: DataFrame, key: list[str], recover: dict[str, Column], columns: list[str]) -> DataFrame:
    """The input of ``split_project``: a join on its unique key. ``recover``: columns in terms of the projection's outputs.

    Keys are compared null-safe, so a row whose key has a null comes back too.
    """
    given = proj.select(*(F.col(k).alias(f"_p_{k}") for k in key), *(c.alias(f"_r_{n}") for n, c in recover.items() if n not in key))
    on = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in key]
    both = complement.join(given, on)
    return both.select(*((F.col(f"_r_{n}") if n in recover and n not in key else F.col(n)).alias(n) for n in columns))


def join3(left: DataFrame, right: DataFrame, p: Column) -> JoinOutputs:
    """Join and both antijoins; only those that are read are computed.

    They are three joins of the same inputs: two that are read in one query
    share the shuffles of their inputs, as Spark reuses equal exchanges.
    """
    return JoinOutputs(left.join(right, p), left.join(right, p, "left_anti"), right.join(left, p, "left_anti"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A key for a table without one. Write the result before use: ids are only fixed once written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unjoin(joined: DataFrame, anti: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """One side of a join from its part of the join and its antijoin.

    ``key`` is unique on that side; without it repeated rows could not be told
    from rows that the join repeats.
    """
    if not key:
        raise ValueError("an input without a unique key cannot be rebuilt from a join")
    return anti.select(*columns).unionByName(joined.select(*columns).dropDuplicates(key))


def has_key(df: DataFrame, key: list[str]) -> bool:
    """Whether ``key`` is unique in ``df``."""
    return df.groupBy(*key).count().filter("count > 1").isEmpty()
