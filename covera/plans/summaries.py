"""Descriptive summaries of policy rows: E9-E12, E15, E16, and hand-set limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covera.operators.joins import checked_broadcast
from covera.operators.quantiles import exact_quantiles
from covera.session import cut_lineage


def value_counts(df: DataFrame, cols: list[str], rare_below: int = 20) -> DataFrame:
    """Rows per combination, and whether it is rare."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).withColumn("is_rare", F.col("n") < rare_below)


def cross_tab(df: DataFrame, row: str, col: str, distinct: str) -> DataFrame:
    """Distinct values of ``distinct`` per (row, col), as a long table: no value is left out."""
    return df.groupBy(row, col).agg(F.countDistinct(distinct).alias("objects"))


def box_stats(df: DataFrame, value: str, groups: list[str], whisker: float = 1.5) -> DataFrame:
    """N, min, quartiles, max and the number of rows outside the whiskers, per group.

    Rows are reduced to (group, value, count) before the quartiles meet them.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n")))
    q = exact_quantiles(df, value, groups, [0.25, 0.5, 0.75], "v")
    at = lambda x: F.max(F.when(F.col("q") == x, F.col("v")))
    wide = cut_lineage(q.groupBy(*groups).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")))
    iqr = F.col("q3") - F.col("q1")
    out = (F.col(value) < F.col("q1") - whisker * iqr) | (F.col(value) > F.col("q3") + whisker * iqr)
    return counts.join(checked_broadcast(wide, wide.count()), groups).groupBy(*groups).agg(
        F.sum("_n").alias("n"), F.min(value).alias("min_v"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.max(value).alias("max_v"), F.sum(F.when(out, F.col("_n")).otherwise(0)).alias("outside"))


def histogram(df: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """Equal-width buckets: bucket, n, bucket_min, overall_min."""
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")))
    lo, hi = counts.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return counts.select(F.lit(0).alias("bucket"), F.col("_n").alias("n"), F.col(value).alias("bucket_min"),
                             F.col(value).alias("overall_min"))
    width = (hi - lo) if hi != lo else 1.0
    bucket = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width) * buckets), F.lit(buckets - 1))
    return counts.groupBy(bucket.cast("int").alias("bucket")).agg(
        F.sum("_n").alias("n"), F.min(value).alias("bucket_min"), F.lit(lo).alias("overall_min"))


def distinct_counts(df: DataFrame, groups: list[str], cols: dict[str, str]) -> DataFrame:
    """Distinct values per group; ``cols`` maps output names to columns."""
    return df.groupBy(*groups).agg(*[F.countDistinct(c).alias(n) for n, c in cols.items()])


def stage_sizes(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of every stage."""
    parts = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def within_limits(df: DataFrame, limits: list[tuple]) -> DataFrame:
    """Rows below every hand-set limit (column, limit, condition); a condition, where given, says which rows it binds.

    A null value is over a limit that binds it.
    """
    def ok(column: str, limit: float, binds: Column | None) -> Column:
        below = F.coalesce(F.col(column) < F.lit(limit), F.lit(False))
        return below if binds is None else below | ~F.coalesce(binds, F.lit(False))

    return df.where(reduce(Column.__and__, [ok(*(x if len(x) == 3 else (*x, None))) for x in limits], F.lit(True)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each version, rows only in one of them, and whether they are equal as multisets."""
    cols = [F.col(f"`{c}`") for c in a.columns]
    counts = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(*cols).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    zero = F.lit(0).cast("long")
    out = counts.agg(F.coalesce(F.sum("_a"), zero).alias("rows_a"), F.coalesce(F.sum("_b"), zero).alias("rows_b"),
                     F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), zero)), zero).alias("only_a"),
                     F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), zero)), zero).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
