"""Operations of a training-data pipeline.

Nothing outside this subpackage imports it.  ``queries()`` and
``oracle_sql()`` gather what each operator module registers.
"""

from __future__ import annotations


def _modules():
    from . import chat_format, decontaminate, exact_dedup, language_id, near_dedup, quality, sentencepiece_sampling, substring_dedup, token_counts, toxicity

    return (decontaminate, sentencepiece_sampling, substring_dedup, near_dedup, exact_dedup, chat_format, toxicity, token_counts, quality, language_id)


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, where SQL can express the operator."""
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
