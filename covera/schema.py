"""Declared schema of a raw policy row and the column groups used throughout."""

from __future__ import annotations

from pyspark.sql import types as T

# Typed columns of a raw policy row (PREMIUM only when labelled).
# The reader casts by name, so the file column order does not matter.
CORE_TYPES = {
    "OBJECT_ID": T.LongType(), "SEX": T.IntegerType(), "INSR_BEGIN": T.StringType(),
    "INSR_END": T.StringType(), "INSR_TYPE": T.IntegerType(), "INSURED_VALUE": T.DoubleType(),
    "PREMIUM": T.DoubleType(), "PROD_YEAR": T.DoubleType(), "SEATS_NUM": T.DoubleType(),
    "CCM_TON": T.DoubleType(), "TYPE_VEHICLE": T.StringType(), "MAKE": T.StringType(),
    "USAGE": T.StringType(),
}

# A contract has no id of its own; these six columns identify it.
IDENTITY_COLS = ["OBJECT_ID", "START_MNTH", "INSURED_VALUE", "SEX", "PREMIUM", "INSR_TYPE"]

# Columns removed after the dates are parsed (absent ones are ignored).
DROPPED_COLS = ["INSR_BEGIN", "INSR_END", "END_MNTH", "EFFECTIVE_YR", "CLAIM_PAID", "CARRYING_CAPACITY"]

# Numeric columns whose medians become inference defaults (OBJECT_ID excluded).
NUMERIC_DEFAULT_COLS = ["SEX", "INSR_TYPE", "INSURED_VALUE", "PREMIUM", "PROD_YEAR",
                        "SEATS_NUM", "CCM_TON", "START_MNTH", "DURATION"]
MODE_DEFAULT_COLS = ["TYPE_VEHICLE", "MAKE", "USAGE"]

# Columns that never reach a model.
MODEL_EXCLUDED = ["PREMIUM", "OBJECT_ID", "START_MNTH", "PROD_YEAR"]

# Default row-order key: the reader numbers rows in file order.
ROW_ID = "_row_id"
