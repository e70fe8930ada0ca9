"""Operators for building training data, and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

from fraudlens.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
