"""Per-object history and state: F2-F4, D4-D5, E13, N1-N5.

Policies of an object are ordered by (START_MNTH, DURATION, row key) within
its segment.  Ordered work per object goes through
:func:`covera.operators.scan.prefix_scan` (a hot object is split across
tasks); last-row and total figures are partial aggregates (``max_by``, ``sum``).

State table: (OBJECT_ID, is_zero, PREVIOUS_PREMIUM double, TOTAL_DURATION long).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.operators.outliers import SEG, with_segment
from covera.operators.scan import prefix_scan

KEY = ["OBJECT_ID", SEG]
STATE_COLS = [*KEY, "PREVIOUS_PREMIUM", "TOTAL_DURATION"]


def order_cols(tie: list[str]) -> list[str]:
    return ["START_MNTH", "DURATION", *tie]


def _order_struct(tie):
    return F.struct(*[F.col(c) for c in order_cols(tie)])


def build_state(df: DataFrame, tie: list[str]) -> DataFrame:
    """Last PREMIUM and total DURATION per (object, segment)."""
    seg = with_segment(df)
    return seg.groupBy(*KEY).agg(
        F.max_by("PREMIUM", _order_struct(tie)).cast("double").alias("PREVIOUS_PREMIUM"),
        F.sum("DURATION").cast("long").alias("TOTAL_DURATION"))


def policy_history(df: DataFrame, tie: list[str]) -> DataFrame:
    """F2-F4 in one ordered pass per (object, segment).

    Adds POLICY_IDX (0 = first policy), PREMIUM_prev (previous policy's premium),
    DURATION_cum (running total incl. this policy), DURATION_first.
    """
    seg = with_segment(df)
    scanned = prefix_scan(seg, KEY, order_cols(tie), sums=["DURATION"], lags=["PREMIUM"], firsts=["DURATION"])
    return scanned.withColumnRenamed("_idx", "POLICY_IDX")


def first_policies(hist: DataFrame) -> DataFrame:
    """the first policy of each object in its segment (first-policy model rows)."""
    return hist.where(F.col("POLICY_IDX") == 0)


def later_history(hist: DataFrame, mode: str = "skip_first") -> DataFrame:
    """Training rows of the later-policy model.

    ``skip_first`` (Q5): the first policy is removed before the lag and the
    running total, so the second policy has no previous premium and is lost,
    and TOTAL_DURATION leaves the first policy out.  ``full`` keeps every
    later policy with the true previous premium and the full running total.
    """
    base = hist.where(F.col("POLICY_IDX") >= (2 if mode == "skip_first" else 1))
    total = F.col("DURATION_cum") - (F.col("DURATION_first") if mode == "skip_first" else F.lit(0))
    return (base.withColumn("PREVIOUS_PREMIUM", F.col("PREMIUM_prev").cast("double"))
                .withColumn("TOTAL_DURATION", total.cast("long"))
                .where(F.col("PREVIOUS_PREMIUM").isNotNull())
                .drop("PREMIUM_prev", "DURATION_cum", "DURATION_first", "POLICY_IDX"))


def split_by_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """D4 + D5 (N2): flag KNOWN objects and enrich them from the state.

    One left join on (OBJECT_ID, is_zero); TOTAL_DURATION = state total + this
    row's DURATION; unknown objects get nulls and go to the first-policy model.
    Several rows of one new object in a batch all count as first (Q6).
    """
    seg = with_segment(batch)
    st = state.select(*KEY, F.col("PREVIOUS_PREMIUM").alias("_st_pp"), F.col("TOTAL_DURATION").alias("_st_td"),
                      F.lit(True).alias("KNOWN"))
    j = seg.join(st, KEY, "left")
    return (j.withColumn("KNOWN", F.coalesce(F.col("KNOWN"), F.lit(False)))
             .withColumn("PREVIOUS_PREMIUM", F.col("_st_pp"))
             .withColumn("TOTAL_DURATION", (F.col("_st_td") + F.col("DURATION")).cast("long"))
             .drop("_st_pp", "_st_td"))


def fold_predictions(state: DataFrame, predicted: DataFrame, tie: list[str], pred_col: str = "prediction",
                     touched_only: bool = False) -> DataFrame:
    """State after a predicted batch (a new version; the old one is untouched).

    New object: (last prediction, DURATION of that last row).
    Known object: (last prediction, state total + sum of the batch DURATIONs).
    Objects absent from the batch keep their state; with ``touched_only`` they
    are left out, which is what a store of deltas writes.
    """
    seg = with_segment(predicted)
    o = _order_struct(tie)
    per_obj = seg.groupBy(*KEY).agg(
        F.max_by(pred_col, o).cast("double").alias("_pp"),
        F.max_by("DURATION", o).cast("long").alias("_last_d"),
        F.sum("DURATION").cast("long").alias("_sum_d"))
    j = state.select(*STATE_COLS, F.lit(True).alias("_in_state")).join(per_obj, KEY, _side(touched_only))
    known = F.coalesce(F.col("_in_state"), F.lit(False))
    in_batch = F.col("_sum_d").isNotNull()
    return j.select(
        *KEY,
        F.when(in_batch, F.col("_pp")).otherwise(F.col("PREVIOUS_PREMIUM")).alias("PREVIOUS_PREMIUM"),
        F.when(in_batch & known, F.col("TOTAL_DURATION") + F.col("_sum_d"))
         .when(in_batch, F.col("_last_d")).otherwise(F.col("TOTAL_DURATION")).cast("long").alias("TOTAL_DURATION"))


def _side(touched_only: bool) -> str:
    return "right_outer" if touched_only else "full_outer"


def update_with_labels(state: DataFrame, labelled: DataFrame, tie: list[str], touched_only: bool = False) -> DataFrame:
    """Labelled rows overwrite the state with their last row (premium, duration).

    The duration replaces the total (Q6); objects not in the batch keep theirs
    (with ``touched_only`` they are left out).
    """
    seg = with_segment(labelled)
    o = _order_struct(tie)
    per_obj = seg.groupBy(*KEY).agg(
        F.max_by("PREMIUM", o).cast("double").alias("_pp"), F.max_by("DURATION", o).cast("long").alias("_d"),
        F.lit(True).alias("_hit"))
    j = state.select(*STATE_COLS).join(per_obj, KEY, _side(touched_only))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*KEY,
                    F.when(hit, F.col("_pp")).otherwise(F.col("PREVIOUS_PREMIUM")).alias("PREVIOUS_PREMIUM"),
                    F.when(hit, F.col("_d")).otherwise(F.col("TOTAL_DURATION")).cast("long").alias("TOTAL_DURATION"))
