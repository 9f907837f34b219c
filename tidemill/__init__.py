"""Workload-aware analytics on Spark: relational operators, their inverses and budgeted reuse of results."""
