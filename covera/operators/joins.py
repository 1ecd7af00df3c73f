"""Lookup joins with a checked broadcast.

Learnt tables (caps, merges, impute groups, encoder maps, rules) are keyed by
categories, so they stay small; still, a side is broadcast only after its size
in bytes (rows times the width of a row) has been checked against a bound.
Beyond the bound, and with no known row count, no hint is given: AQE measures
the side at run time and splits skewed partitions of a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest lookup side, in bytes, that is ever broadcast.
BROADCAST_MAX_BYTES = 32 << 20
# Bytes of a fixed-width cell, and those a text or nested cell is taken to need.
_FIXED, _VARIABLE = 8, 64


def row_bytes(df: DataFrame) -> int:
    variable = ("string", "array", "map", "struct", "binary")
    return sum(_VARIABLE if t.startswith(variable) else _FIXED for _, t in df.dtypes)


def checked_broadcast(small: DataFrame, known_rows: int | None = None,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint when the rows are counted and their bytes are within the bound."""
    if known_rows is not None and known_rows * row_bytes(small) <= max_bytes:
        return F.broadcast(small)
    return small


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left", known_rows: int | None = None) -> DataFrame:
    return big.join(checked_broadcast(small, known_rows), on, how)
