"""Ordered scans per key that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task.  Here rows are range-partitioned on (key, order) instead, so a hot
key is cut into many tasks.  Each piece is scanned on its own (a window over
(partition id, key), which shuffles into pieces of bounded size), and the
pieces are stitched with offsets taken from the partition boundaries: only
the first and last key of a partition can continue into a neighbour, so the
offset table has at most two rows per partition.

Outputs, per row:
  ``_idx``          0-based position within the key (a long),
  ``<c>_cum``       inclusive running sum of each column in ``sums``,
  ``<c>_prev``      value of each column in ``lags`` on the previous row of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covera.session import cut_lineage

_PID = "_pid"


def _struct(cols):
    return F.struct(*[F.col(c) for c in cols])


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], sums=(), lags=(), firsts=(),
                index: bool = True, order_desc: bool = False) -> DataFrame:
    """Running index / sums / lags / first values per key, exact and skew-safe.

    ``order`` must make rows unique within a key (end it with a row key).
    ``firsts`` adds ``<c>_first``: the value on the first row of the key.
    One plan for every size: keys are always cut into range partitions.
    """
    sums, lags, firsts = list(sums), list(lags), list(firsts)
    sort_cols = [F.col(k).asc_nulls_first() for k in keys] + [
        (F.col(o).desc_nulls_last() if order_desc else F.col(o).asc_nulls_first()) for o in order]
    # 1. Range partition on the full sort key and write the result with its
    #    partition number (sampled bounds are not stable on recompute, a table is).
    ranged = cut_lineage(df.repartitionByRange(*sort_cols).withColumn(_PID, F.spark_partition_id()))

    # 2. Boundary keys of each partition (one row per partition).
    ends = ranged.groupBy(_PID).agg(F.min(_struct(keys)).alias("_first"), F.max(_struct(keys)).alias("_last"))
    bkeys = (ends.select(_PID, F.col("_first").alias("_k"))
             .unionByName(ends.select(_PID, F.col("_last").alias("_k"))).distinct()
             .select(F.col(_PID).alias("_b_pid"), *[F.col(f"_k.{k}").alias(f"_b_{k}") for k in keys]))

    # 3. Per (partition, boundary key): row count, sums, last lag values.
    last_by = F.struct(*[F.col(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(c).alias(f"_s_{c}") for c in sums]
    for c in lags:
        aggs.append((F.min_by(c, last_by) if order_desc else F.max_by(c, last_by)).alias(f"_l_{c}"))
    for c in firsts:
        aggs.append((F.max_by(c, last_by) if order_desc else F.min_by(c, last_by)).alias(f"_f_{c}"))
    # Null-safe keys: a null key is a key like any other.
    cond = [F.col(_PID) == F.col("_b_pid")] + [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    bstats = (ranged.join(F.broadcast(bkeys), cond, "left_semi")
              .groupBy(_PID, *keys).agg(*aggs))

    # 4. Offsets from earlier partitions of the same key (tiny window).
    wk = Window.partitionBy(*keys).orderBy(_PID)
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    offs = bstats.select(
        F.col(_PID).alias("_o_pid"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.lag(f"_l_{c}", 1).over(wk).alias(f"_lagin_{c}") for c in lags],
        *[F.first(f"_f_{c}").over(wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_first_{c}")
          for c in firsts],
    )
    offs = offs.where((F.col("_off_n") > 0))

    # 5. Local scan per (partition, key) piece, then add the offsets.
    wl = Window.partitionBy(_PID, *keys).orderBy(*[
        (F.col(o).desc_nulls_last() if order_desc else F.col(o).asc_nulls_first()) for o in order])
    run = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*",
        (F.row_number().over(wl) - 1).alias("_lidx"),
        *[F.sum(c).over(run).alias(f"_lsum_{c}") for c in sums],
        *[F.lag(c, 1).over(wl).alias(f"_llag_{c}") for c in lags],
        *[F.first(c).over(run).alias(f"_lfirst_{c}") for c in firsts],
    )
    ocond = [F.col(_PID) == F.col("_o_pid")] + [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    joined = local.join(F.broadcast(offs), ocond, "left")
    out_cols = [local[c] for c in df.columns]
    if index:
        out_cols.append((local["_lidx"] + F.coalesce(offs["_off_n"], F.lit(0))).alias("_idx"))
    for c in sums:
        out_cols.append((local[f"_lsum_{c}"] + F.coalesce(offs[f"_off_{c}"], F.lit(0))).alias(f"{c}_cum"))
    for c in lags:
        first_here = local["_lidx"] == 0
        out_cols.append(F.when(first_here, offs[f"_lagin_{c}"]).otherwise(local[f"_llag_{c}"]).alias(f"{c}_prev"))
    for c in firsts:
        out_cols.append(F.when(offs["_off_n"].isNotNull(), offs[f"_first_{c}"]).otherwise(local[f"_lfirst_{c}"])
                        .alias(f"{c}_first"))
    return joined.select(*out_cols)
