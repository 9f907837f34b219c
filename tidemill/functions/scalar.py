"""Scalar functions with SQL semantics; all of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands in for a missing column when a union pads one side, by Spark type name.
DEFAULTS = {"int": 0, "bigint": -1, "double": 0.0, "string": "", "boolean": False}


def substring(s: Column, start: int, length: int) -> Column:
    """``substring(s from start for length)``, counted from 1."""
    return F.substring(s, start, length)


def prefix(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def suffix(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def like_column(s: Column, pattern: str) -> Column:
    """LIKE; patterns with a ``%`` at one end or both become tests that a scan can push down."""
    body = pattern.strip("%")
    if "%" in body or "_" in pattern or "\\" in pattern:
        return s.like(pattern)
    head, tail = pattern.startswith("%"), pattern.endswith("%") and pattern != ""
    if pattern and not body:
        return F.when(s.isNotNull(), True)
    if head and tail:
        return s.contains(body)
    if head:
        return s.endswith(body)
    return s.startswith(body) if tail else s == body


def extract(part: str, d: Column) -> Column:
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[part](d)
