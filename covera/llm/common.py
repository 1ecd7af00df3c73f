"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covera.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """Bind a value once inside an expression: ``use`` gets it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def ordered_scan(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), index: str = "_g") -> DataFrame:
    """Global 0-based position of every row in ``order``, and exclusive running sums.

    The rows are range-partitioned and sorted once and written as a table, so
    no key, however frequent, is gathered in one task.  The positions of a
    partition's rows come from ``monotonically_increasing_id`` (partition
    number and position inside it) and are shifted by the rows of the
    partitions before it; that offset table has one row per partition, which
    bounds its broadcast.  Rows equal in all of ``order`` share their
    positions in an arbitrary way, so ``order`` names every column that the
    result depends on.  An empty input gives an empty output.
    """
    pinned = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    rows = (pinned.withColumn("_pid", F.shiftright("_m", 33))
            .withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    shift = parts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    if sums:
        here = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_r_{c}") for c in sums])
    return rows.join(F.broadcast(shift), "_pid").select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(index),
        *[(F.col(f"_r_{c}") + F.col(f"_s_{c}")).alias(f"{c}_before") for c in sums])
