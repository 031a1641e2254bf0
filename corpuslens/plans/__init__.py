"""Plans that bind the operators to the given tables, with the SQL each must equal."""

from __future__ import annotations


def load_queries():
    """All registered queries and their SQL."""
    from . import assess_events, assess_models, draws, prepare, training_rows  # noqa: F401
    from .catalog import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL
