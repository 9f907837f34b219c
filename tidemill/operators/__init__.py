"""Relational operators on DataFrames, and their inverses."""
