"""Base cleaning (K1) and its parts: B1-B2, B4-B7, C1-C3, D1, F1.

Order of the base clean:
  C1 drop null OBJECT_ID -> B1/B2 month index and duration
  -> (train) C2 DURATION > 0 -> (train) F1 de-duplicate contracts, keep the longest
  -> B7 drop unused columns -> B6 'Trade plates' reset
  -> (train) C3 drop null PREMIUM -> D1 standardise MAKE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.functions.columns import (TRADE_PLATES, TRADE_PLATES_YEAR, duration, make_key,
                                      month_index)
from covera.operators.joins import lookup_join
from covera.session import cut_lineage
from covera.schema import DROPPED_COLS, IDENTITY_COLS


def drop_null_objects(df: DataFrame) -> DataFrame:
    """C1."""
    return df.where(F.col("OBJECT_ID").isNotNull())


def with_months(df: DataFrame) -> DataFrame:
    """B1, B2: START_MNTH, END_MNTH, DURATION.

    The months leave a one-row generator, so that a filter on the duration reads
    them: pushed below a plain projection it would parse both texts again.
    """
    months = F.struct(month_index("INSR_BEGIN").alias("START_MNTH"), month_index("INSR_END").alias("END_MNTH"))
    return (df.drop("START_MNTH", "END_MNTH", "DURATION").select("*", F.inline(F.array(months)))
              .withColumn("DURATION", duration("START_MNTH", "END_MNTH")))


def keep_positive_duration(df: DataFrame) -> DataFrame:
    """C2 (training only)."""
    return df.where(F.col("DURATION") > 0)


def dedup_contracts(df: DataFrame, tie: list[str]) -> DataFrame:
    """one row per contract (the six identity columns, nulls equal).

    Keeps the row a stable sort by (OBJECT_ID, START_MNTH, DURATION) would put
    last: the longest, then the last by row key.  A partial aggregate
    (``max_by``) instead of a window, so a contract repeated a billion times
    is reduced map-side and never gathered in one task.
    """
    rest = [c for c in df.columns if c not in IDENTITY_COLS]
    pick = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col("DURATION"), *[F.col(t) for t in tie]))
    return df.groupBy(*IDENTITY_COLS).agg(pick.alias("_kept")).select(*IDENTITY_COLS, "_kept.*")


def drop_unused(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Drop the date texts, END_MNTH and never-used columns when present."""
    return df.drop(*[c for c in list(DROPPED_COLS) + list(extra) if c in df.columns])


def _without_unused(df: DataFrame, tie: list[str]) -> DataFrame:
    """B7 ahead of the shuffle, which carries what is not dropped; the row key stays."""
    return df.drop(*[c for c in DROPPED_COLS if c in df.columns and c not in tie])


def reset_trade_plates(df: DataFrame) -> DataFrame:
    """B6: 'Trade plates' rows get CCM_TON = SEATS_NUM = 0 and a missing PROD_YEAR of 2010."""
    tp = F.col("TYPE_VEHICLE") == F.lit(TRADE_PLATES)
    return df.withColumns({
        "CCM_TON": F.when(tp, F.lit(0.0)).otherwise(F.col("CCM_TON")),
        "SEATS_NUM": F.when(tp, F.lit(0.0)).otherwise(F.col("SEATS_NUM")),
        "PROD_YEAR": F.when(tp & F.col("PROD_YEAR").isNull(), F.lit(TRADE_PLATES_YEAR)).otherwise(F.col("PROD_YEAR")),
    })


def drop_null_premium(df: DataFrame) -> DataFrame:
    """C3 (training only)."""
    return df.where(F.col("PREMIUM").isNotNull())


def make_lookup(make_map: DataFrame) -> DataFrame:
    """Close the map over its values (v -> v); on a clash the identity wins.

    Input (raw, canonical); output (MAKE_KEY, MAKE_STD), one row per key.
    """
    mapped = make_map.select(F.col("raw").alias("MAKE_KEY"), F.col("canonical").alias("MAKE_STD"), F.lit(1).alias("_prio"))
    ident = make_map.select(F.col("canonical").alias("MAKE_KEY"), F.col("canonical").alias("MAKE_STD"), F.lit(0).alias("_prio"))
    both = mapped.unionByName(ident).where(F.col("MAKE_KEY").isNotNull())
    return both.groupBy("MAKE_KEY").agg(F.min_by("MAKE_STD", "_prio").alias("MAKE_STD"))


def standardise_make(df: DataFrame, lookup: DataFrame, lookup_rows: int | None = None) -> DataFrame:
    """MAKE -> canonical make through the closed map; a miss is 'UNKNOWN'."""
    keyed = df.withColumn("MAKE_KEY", make_key("MAKE"))
    joined = lookup_join(keyed, lookup, "MAKE_KEY", "left", known_rows=lookup_rows)
    return joined.withColumn("MAKE", F.coalesce(F.col("MAKE_STD"), F.lit("UNKNOWN"))).drop("MAKE_KEY", "MAKE_STD")


def base_clean(df: DataFrame, make_lookup_df: DataFrame, train: bool, tie: list[str],
               lookup_rows: int | None = None) -> DataFrame:
    """K1: the base clean; ``make_lookup_df`` is the output of :func:`make_lookup`."""
    out = with_months(drop_null_objects(df))
    if train:
        out = dedup_contracts(_without_unused(keep_positive_duration(out), tie), tie)
    return _finish(out, make_lookup_df, train, lookup_rows)


def _finish(rows: DataFrame, make_lookup_df: DataFrame, train: bool, lookup_rows: int | None) -> DataFrame:
    out = reset_trade_plates(drop_unused(rows))
    if train:
        out = drop_null_premium(out)
    return standardise_make(out, make_lookup_df, lookup_rows)


#: Why a row does not reach the de-duplication; null for those that do.
_REASON, _COPIES = "_reason", "_copies"


def counted_contracts(df: DataFrame, tie: list[str]) -> DataFrame:
    """One row per contract as :func:`dedup_contracts` leaves it, with the number of its rows (``_copies``),
    and one row per reason (``_reason``: null_object, duration) that counts the rows it removed.

    So all counters of the clean come from one scan, and from data rather than task counters,
    which a repeated stage would count twice.
    """
    months = _without_unused(with_months(df), tie)
    reason = F.when(F.col("OBJECT_ID").isNull(), "null_object").when(
        ~F.coalesce(F.col("DURATION") > 0, F.lit(False)), "duration")
    keyed = months.withColumn(_REASON, reason).withColumns(
        {c: F.when(F.col(_REASON).isNull(), F.col(c)) for c in IDENTITY_COLS})
    rest = [c for c in months.columns if c not in IDENTITY_COLS]
    pick = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col("DURATION"), *[F.col(t) for t in tie]))
    return keyed.groupBy(_REASON, *IDENTITY_COLS).agg(pick.alias("_kept"), F.count(F.lit(1)).alias(_COPIES)).select(
        *IDENTITY_COLS, "_kept.*", _REASON, _COPIES)


def base_clean_report(df: DataFrame, make_lookup_df: DataFrame, train: bool, tie: list[str],
                      lookup_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned rows, counters (stage, metric, value), rows read (n)) from one scan of the input."""
    tp = F.col("TYPE_VEHICLE") == F.lit(TRADE_PLATES)
    here = F.col(_REASON).isNull()
    counts = {f"trade_plates_{name}": F.count_if(here & tp & F.col(c).isNull())
              for name, c in (("CCM_TON_nan", "CCM_TON"), ("SEATS_NUM_nan", "SEATS_NUM"), ("prod_year_nan", "PROD_YEAR"))}
    if train:
        staged = cut_lineage(counted_contracts(df, tie))
        removed = lambda r: F.coalesce(F.sum(F.when(F.col(_REASON) == r, F.col(_COPIES))), F.lit(0))
        before = F.coalesce(F.sum(F.when(here, F.col(_COPIES))), F.lit(0))
        counts = {"null_object_removed": removed("null_object"), "INSR_ZERO_duration_removed": removed("duration"),
                  "rows_before_dedup": before, "rows_after_dedup": F.count_if(here),
                  "duplicates_removed": before - F.count_if(here),
                  **counts, "premium_nan_count": F.count_if(here & F.col("PREMIUM").isNull())}
        size = staged.agg(F.coalesce(F.sum(_COPIES), F.lit(0)).cast("long").alias("n"))
    else:
        staged = cut_lineage(with_months(df).withColumn(_REASON, F.when(F.col("OBJECT_ID").isNull(), "null_object")))
        counts = {"null_object_removed": F.count_if(~here), **counts}
        size = staged.agg(F.count(F.lit(1)).alias("n"))
    # Not written once more: from the staged rows it is a projection and a lookup.
    cleaned = _finish(staged.where(here).drop(_REASON, _COPIES), make_lookup_df, train, lookup_rows)
    unknown = cleaned.agg(F.count_if(F.col("MAKE") == "UNKNOWN").alias("unknown_makes"))
    return cleaned, _long_counts(staged.agg(*[c.alias(n) for n, c in counts.items()])).unionByName(_long_counts(unknown)), size


def _long_counts(row: DataFrame) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit("nans").alias("stage"), F.lit(n).alias("metric"), F.col(n).cast("long").alias("value"))
        for n in row.columns])).alias("s")).select("s.*")


def base_clean_metrics(df: DataFrame, make_lookup_df: DataFrame, train: bool, tie: list[str]) -> DataFrame:
    """Counters of the base clean as a long table (stage, metric, value)."""
    return base_clean_report(df, make_lookup_df, train, tie)[1]
