"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Rules that hold for every operator here: a missing text counts as an empty one unless the
docstring says otherwise, input columns beyond those an operator names are ignored or
passed through under their own names, and intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir``.
"""


def load_llm_queries():
    """The registered queries of this package and the SQL each must equal."""
    from .queries import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL
