"""The relational algebra as functions on DataFrames; Catalyst picks the physical plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DEFAULTS


def select(df: DataFrame, p: Column) -> DataFrame:
    return df.filter(p)


def project(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in named.items()))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def join(left: DataFrame, right: DataFrame, p: Column) -> DataFrame:
    """Inner join; equalities become join keys, anything else a condition."""
    return left.join(right, p, "inner")


def left_outer(left: DataFrame, right: DataFrame, p: Column) -> DataFrame:
    return left.join(right, p, "left_outer")


def left_antijoin(left: DataFrame, right: DataFrame, p: Column) -> DataFrame:
    return left.join(right, p, "left_anti")


def right_antijoin(left: DataFrame, right: DataFrame, p: Column) -> DataFrame:
    return right.join(left, p, "left_anti")


def semi(left: DataFrame, right: DataFrame, p: Column) -> DataFrame:
    return left.join(right, p, "left_semi")


def distinct_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of ``df`` cut to ``columns``."""
    return df.select(*columns).distinct()


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union with the columns of ``left``; those that ``right`` misses hold the type's default there."""
    have = set(right.columns)
    padded = [F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.dataType.simpleString())).cast(f.dataType).alias(f.name) for f in left.schema.fields]
    return left.unionByName(right.select(*padded))


def group(df: DataFrame, keys: list[Column], named: dict[str, Column], key_names: list[str | None] | None = None) -> DataFrame:
    """Outputs over groups; without keys one row. An output that is a key's name is that key."""
    names = key_names or [None] * len(keys)
    inner = [f"_k{i}" for i in range(len(keys))]
    by = {n: i for n, i in zip(names, inner, strict=True) if n}
    if not keys:
        return df.agg(*(c.alias(n) for n, c in named.items()))
    out = df.withColumns(dict(zip(inner, keys, strict=True))).groupBy(*inner)
    aggregates = [(F.first(F.col(by[n])) if n in by and str(c) == str(F.col(n)) else c).alias(n) for n, c in named.items()]
    return out.agg(*aggregates).select(*named)


def sort(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, a top-n where ``df`` is ordered; a negative ``n`` is no limit."""
    return df if n < 0 else df.limit(n)


def drop(df: DataFrame, n: int) -> DataFrame:
    """All but the first ``n`` rows."""
    return df.offset(n)
