"""Group imputation and inference defaults: E1-E4, D2, K2, K3.

Learnt in one grouped pass over the base-cleaned rows:
  CCM_TON       mean over rows with CCM_TON != 0 (null rows kept, skipped by avg)
  SEATS_NUM     mean over non-null rows
  PROD_YEAR     median over non-null rows (exact, see quantiles.py)
  INSURED_VALUE mean over non-null rows
per (TYPE_VEHICLE, MAKE).  Each column has its own hit flag: a group can be
known for one column and unknown for another.  A hit with a null value
imputes null (the group existed but had no value), a miss keeps the cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.functions.columns import object_age
from covera.operators.joins import lookup_join
from covera.operators.quantiles import exact_quantiles
from covera.schema import MODE_DEFAULT_COLS, NUMERIC_DEFAULT_COLS

GROUP = ["TYPE_VEHICLE", "MAKE"]

# What counts as missing for each imputed column.
MISSING = {
    "CCM_TON": lambda c: F.coalesce(c == 0, F.lit(False)),  # zero means missing, null is kept (Q12)
    "SEATS_NUM": lambda c: c.isNull() | F.isnan(c),
    "PROD_YEAR": lambda c: c.isNull() | F.isnan(c),
    "INSURED_VALUE": lambda c: c.isNull() | F.isnan(c),
}
IMPUTED = list(MISSING)


def learn_impute_table(k1: DataFrame, medians: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """E1 + E2: (TYPE_VEHICLE, MAKE, <col>_hit, <col>_fill) for the four columns.

    ``medians`` (TYPE_VEHICLE, MAKE, PROD_YEAR_fill) may come from a shared
    quantile pass; otherwise it is computed here (``stored``: ``k1`` reads a written table).
    """
    keyed = k1.where(F.col("TYPE_VEHICLE").isNotNull() & F.col("MAKE").isNotNull())
    aggs = []
    for col in ["CCM_TON", "SEATS_NUM", "INSURED_VALUE"]:
        present = ~MISSING[col](F.col(col))
        aggs.append(F.count_if(present).alias(f"{col}_n"))
        aggs.append(F.avg(F.when(present, F.col(col))).alias(f"{col}_fill"))
    aggs.append(F.count_if(~MISSING["PROD_YEAR"](F.col("PROD_YEAR"))).alias("PROD_YEAR_n"))
    means = keyed.groupBy(*GROUP).agg(*aggs)
    if medians is None:
        medians = exact_quantiles(keyed.select(*GROUP, "PROD_YEAR"), "PROD_YEAR", GROUP, [0.5],
                                  "PROD_YEAR_fill", stored=stored).drop("q")
    return impute_table_of(means, medians)


def impute_table_of(means: DataFrame, medians: DataFrame) -> DataFrame:
    """The lookup from means and counts (<col>_n, <col>_fill) and the medians of PROD_YEAR."""
    table = means.join(medians, GROUP, "left")
    return table.select(*GROUP, *[x for col in IMPUTED for x in (
        (F.col(f"{col}_n") > 0).alias(f"{col}_hit"), F.col(f"{col}_fill"))])


def apply_impute(df: DataFrame, table: DataFrame, table_rows: int | None = None) -> DataFrame:
    """One broadcast left join on (TYPE_VEHICLE, MAKE), four conditional fills."""
    j = lookup_join(df, table, GROUP, "left", known_rows=table_rows)
    fills = {}
    for col in IMPUTED:
        c = F.col(col)
        hit = F.coalesce(F.col(f"{col}_hit"), F.lit(False))
        fills[col] = F.when(MISSING[col](c) & hit, F.col(f"{col}_fill")).otherwise(c)
    return j.withColumns(fills).drop(*[x for col in IMPUTED for x in (f"{col}_hit", f"{col}_fill")])


def impute_counts(df: DataFrame) -> DataFrame:
    """Cells each fill looks at (the `<col>_imputed` counters), one aggregate."""
    return df.agg(*[F.count_if(MISSING[c](F.col(c))).alias(f"{c}_imputed") for c in IMPUTED])


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls (and NaN) per column, all columns in one aggregate."""
    cols = cols or df.columns
    out = []
    for c in cols:
        miss = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            miss = miss | F.isnan(F.col(c))
        out.append(F.count_if(miss).alias(c))
    return df.agg(*out)


def learn_defaults(k1: DataFrame, medians: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """E3 + E4: long table (col, num_value, text_value), one row per column.

    Exact medians of the numeric columns (stacked; ``stored``: ``k1`` reads a
    written table) and modes of the text columns (smallest value on a tie).
    """
    stacked = k1.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in NUMERIC_DEFAULT_COLS
    ])).alias("s")).select("s.*")
    if medians is None:
        medians = exact_quantiles(stacked, "v", ["col"], [0.5], "num_value", stored=stored)
    med = medians.select("col", "num_value", F.lit(None).cast("string").alias("text_value"))
    # Counted by value first, so that no task holds all values of a column; nulls count as nothing.
    texts = k1.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in MODE_DEFAULT_COLS])).alias("s")).select("s.*")
    return med.unionByName(modes_of(texts.groupBy("col", "v").agg(F.count("v").alias("n"))))


def modes_of(counts: DataFrame) -> DataFrame:
    """The most frequent value of every column, the smallest on a tie, from (col, v, n)."""
    return counts.groupBy("col").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).select(
        "col", F.lit(None).cast("double").alias("num_value"), F.col("m.v").alias("text_value"))


def defaults_dict(defaults: DataFrame) -> dict:
    """The defaults table is one row per column (a dozen rows): safe to collect."""
    return {r["col"]: (r["text_value"] if r["text_value"] is not None else r["num_value"])
            for r in defaults.collect()}


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """K3: fill remaining nulls with learnt defaults, cast to each column's type."""
    types = dict(df.dtypes)
    fills = {}
    for c, v in defaults.items():
        if c in types and v is not None:
            cur = F.when(~F.isnan(F.col(c)), F.col(c)) if types[c] in ("double", "float") else F.col(c)
            fills[c] = F.coalesce(cur, F.lit(v).cast(types[c]))
    return df.withColumns(fills)


def full_clean(k1: DataFrame, impute_table: DataFrame, train: bool, defaults: dict | None = None,
               table_rows: int | None = None) -> DataFrame:
    """K2: D2 imputation, then C4 (train: drop any null) or K3 (inference), then B3."""
    return finish_clean(apply_impute(k1, impute_table, table_rows), train, defaults)


def finish_clean(imputed: DataFrame, train: bool, defaults: dict | None = None) -> DataFrame:
    """C4 (train: drop any null) or K3 (inference), then B3, on imputed rows."""
    out = imputed.na.drop("any") if train else fill_defaults(imputed, defaults or {})
    return out.withColumn("OBJECT_AGE", object_age("START_MNTH", "PROD_YEAR"))
