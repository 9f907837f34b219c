"""Scalar and aggregate functions of the algebra, as Spark columns."""

from .scalar import DEFAULTS, extract, like_column, prefix, substring, suffix

__all__ = ["DEFAULTS", "extract", "like_column", "prefix", "substring", "suffix"]
