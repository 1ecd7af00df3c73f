"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
registers :data:`covera.llm.queries.QUERIES` only when it can be imported.
"""
