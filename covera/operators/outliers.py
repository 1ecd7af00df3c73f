"""Outlier caps and category merges: E5, E6, C5-C7, B12, K4.

Caps are learnt per segment (``is_zero``) from the base-cleaned rows:
  scalar      PREMIUM (both segments), INSURED_VALUE (the non-zero segment)
  by type     SEATS_NUM and CCM_TON per TYPE_VEHICLE present in the segment
as linear-interpolated quantiles (default 0.99).  A row is kept when the value
is strictly below its cap; a null value or a missing cap drops the row, and a
type absent from the cap table is dropped.  Merges replace old -> new in list
order per (segment, column), so replacements chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.functions.columns import is_zero
from covera.operators.joins import checked_broadcast, lookup_join
from covera.operators.quantiles import exact_quantiles, sketch_quantiles
from covera.schema import NUMERIC_DEFAULT_COLS
from covera.session import cut_lineage

SEG = "is_zero"
TYPE_CAPPED = ["SEATS_NUM", "CCM_TON"]


def with_segment(df: DataFrame) -> DataFrame:
    """One frame, segment as a column (never two scans)."""
    return df if SEG in df.columns else df.withColumn(SEG, is_zero("INSURED_VALUE"))


def learn_caps(k1: DataFrame, q: float = 0.99, caps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E5 + E6 in one stacked exact-quantile pass (``caps`` may come from a shared one).

    Returns (caps_scalar(is_zero, col, cap), caps_by_type(is_zero, TYPE_VEHICLE,
    SEATS_NUM_cap, CCM_TON_cap)).
    """
    seg = with_segment(k1)
    items = [
        F.struct(F.lit("PREMIUM").alias("col"), F.lit("").alias("vt"), F.col("PREMIUM").alias("v")),
        F.struct(F.lit("INSURED_VALUE").alias("col"), F.lit("").alias("vt"),
                 F.when(~F.col(SEG), F.col("INSURED_VALUE")).alias("v")),
    ] + [F.struct(F.lit(c).alias("col"), F.col("TYPE_VEHICLE").alias("vt"), F.col(c).alias("v")) for c in TYPE_CAPPED]
    stacked = seg.select(SEG, F.explode(F.array(*items)).alias("s")).select(SEG, "s.*")
    if caps is None:  # (is_zero, col, vt, cap) may come from a shared quantile pass
        caps = exact_quantiles(stacked, "v", [SEG, "col", "vt"], [q], "cap").drop("q")
    return cap_tables(caps, seg.where(F.col("TYPE_VEHICLE").isNotNull()).select(SEG, "TYPE_VEHICLE").distinct())


def cap_tables(caps: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The caps (is_zero, col, vt, cap) as a scalar table and one by the ``types`` of each segment."""
    scalar = caps.where(F.col("col").isin("PREMIUM", "INSURED_VALUE")).select(SEG, "col", "cap")
    by_type = (caps.where(F.col("col").isin(*TYPE_CAPPED))
               .groupBy(SEG, F.col("vt").alias("TYPE_VEHICLE"))
               .pivot("col", TYPE_CAPPED).agg(F.first("cap")))
    by_type = types.join(by_type, [SEG, "TYPE_VEHICLE"], "left").select(
        SEG, "TYPE_VEHICLE", *[F.col(c).alias(f"{c}_cap") for c in TYPE_CAPPED])
    return scalar, by_type


def scalar_caps_dict(caps_scalar: DataFrame) -> dict:
    """At most four rows (two segments x two columns): safe to collect."""
    return {(r[SEG], r["col"]): r["cap"] for r in caps_scalar.collect()}


def _below(c, cap, inclusive: bool):
    return (F.col(c) <= cap) if inclusive else (F.col(c) < cap)


def cap_flags(df: DataFrame, scalar: dict, by_type: DataFrame, by_type_rows: int | None = None,
              inclusive: bool = False) -> DataFrame:
    """Adds one keep flag per filter, in this order:
    PREMIUM, INSURED_VALUE (non-zero segment only), SEATS_NUM, CCM_TON.

    The PREMIUM cap is skipped when the batch has no PREMIUM column.
    """
    seg = with_segment(df)
    flags = {}
    if "PREMIUM" in seg.columns:
        cap = F.when(F.col(SEG), F.lit(scalar.get((True, "PREMIUM")))).otherwise(F.lit(scalar.get((False, "PREMIUM"))))
        flags["_k_PREMIUM"] = F.coalesce(_below("PREMIUM", cap.cast("double"), inclusive), F.lit(False))
    icap = F.lit(scalar.get((False, "INSURED_VALUE"))).cast("double")
    flags["_k_INSURED_VALUE"] = F.col(SEG) | F.coalesce(_below("INSURED_VALUE", icap, inclusive), F.lit(False))
    joined = lookup_join(seg.withColumns(flags), by_type, [SEG, "TYPE_VEHICLE"], "left", known_rows=by_type_rows)
    more = {f"_k_{c}": F.coalesce(_below(c, F.col(f"{c}_cap"), inclusive), F.lit(False)) for c in TYPE_CAPPED}
    return joined.withColumns(more).drop(*[f"{c}_cap" for c in TYPE_CAPPED])


CAP_ORDER = ["PREMIUM", "INSURED_VALUE"] + TYPE_CAPPED


def apply_caps(df: DataFrame, scalar: dict, by_type: DataFrame, by_type_rows: int | None = None,
               inclusive: bool = False) -> DataFrame:
    """C5 + C6: keep rows under every cap of their segment."""
    flagged = cap_flags(df, scalar, by_type, by_type_rows, inclusive)
    names = [f"_k_{c}" for c in CAP_ORDER if f"_k_{c}" in flagged.columns]
    keep = F.lit(True)
    for n in names:
        keep = keep & F.col(n)
    return flagged.where(keep).drop(*names)


def cap_metrics(df: DataFrame, scalar: dict, by_type: DataFrame, by_type_rows: int | None = None,
                inclusive: bool = False) -> DataFrame:
    """Rows removed by each cap in order (a row counts for the first cap it fails),
    segment sizes before and after; long table (segment, metric, value)."""
    flagged = cap_flags(df, scalar, by_type, by_type_rows, inclusive)
    names = [c for c in CAP_ORDER if f"_k_{c}" in flagged.columns]
    aggs, passed = [F.count(F.lit(1)).alias("records")], F.lit(True)
    for c in names:
        aggs.append(F.count_if(passed & ~F.col(f"_k_{c}")).alias(f"removed_{c}"))
        passed = passed & F.col(f"_k_{c}")
    aggs.append(F.count_if(passed).alias("final_records"))
    per_seg = flagged.groupBy(SEG).agg(*aggs)
    metrics = ["records"] + [f"removed_{c}" for c in names] + ["final_records"]
    return per_seg.select(F.when(F.col(SEG), "INSR_ZERO").otherwise("ELSE").alias("segment"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics])).alias("s")
    ).select("segment", "s.metric", "s.value")


MERGE_SCHEMA = "is_zero boolean, col string, seq int, old string, new string"


def as_table(spark, merges) -> DataFrame:
    """Merges (is_zero, col, seq, old, new) as a table; a list holds hand-set ones."""
    if isinstance(merges, DataFrame):
        return merges
    return spark.createDataFrame([(bool(z), c, int(s), str(o), str(n)) for z, c, s, o, n in merges], MERGE_SCHEMA)


def resolve_merges(merges: DataFrame) -> DataFrame:
    """(is_zero, col, old, final): what every replaced category becomes in the end.

    Replacements run in seq order and see earlier ones, so A -> B then B -> C
    sends A to C.  A value meets the steps as one array per segment and column
    (pairs of that column's categories, not rows of data), folded by ``aggregate``.
    """
    key = [SEG, "col"]
    steps = merges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        F.col("seq").cast("int").alias("seq"), F.col("old").cast("string").alias("old"),
        F.col("new").cast("string").alias("new")))).alias("_steps"))
    values = merges.select(*key, F.col("old").cast("string").alias("old")).distinct()
    final = F.aggregate("_steps", F.col("old"), lambda cur, s: F.when(cur == s["old"], s["new"]).otherwise(cur))
    return values.join(steps, key).select(*key, "old", final.alias("final")).where("final != old")


def apply_merges(df: DataFrame, merges) -> DataFrame:
    """Every column's merges as one join with its resolved categories; the plan does not grow with them."""
    seg = with_segment(df)
    table = as_table(df.sparkSession, merges)
    cols = [r["col"] for r in table.select("col").distinct().collect() if r["col"] in seg.columns]
    if not cols:
        return seg
    resolved = cut_lineage(resolve_merges(table))
    sizes = {r["col"]: r["count"] for r in resolved.groupBy("col").count().collect()}
    out, types = seg, dict(seg.dtypes)
    for c in sorted(cols):
        side = resolved.where(F.col("col") == c).select(F.col(SEG).alias("_seg"), F.col("old").alias("_old"),
                                                       F.col("final").alias("_final"))
        side = checked_broadcast(side, sizes.get(c, 0))
        out = out.join(side, (out[SEG] == side["_seg"]) & (out[c].cast("string") == side["_old"]), "left").select(*[
            F.coalesce(F.col("_final").cast(types[c]), F.col(c)).alias(c) if n == c else F.col(n) for n in out.columns])
    return out


def outlier_stage(df: DataFrame, scalar: dict, by_type: DataFrame, merges,
                  by_type_rows: int | None = None, inclusive: bool = False) -> DataFrame:
    """K4: caps first (on unmerged types), then merges."""
    return apply_merges(apply_caps(df, scalar, by_type, by_type_rows, inclusive), merges)


#: What one quantile is asked of: the use it has, and up to three names.
QUANTILE_KEY = ["kind", "a", "b", "c"]


def quantile_items(k1: DataFrame) -> DataFrame:
    """(kind, a, b, c, v): the values of every quantile the fit needs, stacked."""
    seg = with_segment(k1)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(None).cast("string"))
    items = [F.struct(F.lit("impute").alias("kind"), s("TYPE_VEHICLE").alias("a"), s("MAKE").alias("b"),
                      F.lit("").alias("c"), F.col("PROD_YEAR").cast("double").alias("v"))]
    items += [F.struct(F.lit("default").alias("kind"), F.lit(c).alias("a"), F.lit("").alias("b"), F.lit("").alias("c"),
                       F.col(c).cast("double").alias("v")) for c in NUMERIC_DEFAULT_COLS]
    items += [F.struct(F.lit("cap").alias("kind"), F.col(SEG).cast("string").alias("a"), F.lit("PREMIUM").alias("b"),
                       F.lit("").alias("c"), F.col("PREMIUM").cast("double").alias("v")),
              F.struct(F.lit("cap").alias("kind"), F.col(SEG).cast("string").alias("a"),
                       F.lit("INSURED_VALUE").alias("b"), F.lit("").alias("c"),
                       F.when(~F.col(SEG), F.col("INSURED_VALUE")).cast("double").alias("v"))]
    items += [F.struct(F.lit("cap").alias("kind"), F.col(SEG).cast("string").alias("a"), F.lit(c).alias("b"),
                       F.col("TYPE_VEHICLE").alias("c"), F.col(c).cast("double").alias("v")) for c in TYPE_CAPPED]
    return seg.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def fit_quantiles(k1: DataFrame, cap_q: float = 0.99, sketch_k: int | None = None) -> dict:
    """Every quantile the fit needs, in one stacked pass: exact, or by sketches of size ``sketch_k``.

    Impute medians (PROD_YEAR per type and make), default medians (numeric
    columns) and caps (per segment, column and type) share the scans of ``k1``,
    a written table.  Returns the three tables in the shapes
    learn_impute_table, learn_defaults and learn_caps take.
    """
    stacked, asked = quantile_items(k1), [0.5, cap_q]
    qs = (exact_quantiles(stacked, "v", QUANTILE_KEY, asked, "value", stored=True) if sketch_k is None else
          sketch_quantiles(stacked, "v", QUANTILE_KEY, asked, "value", sketch_k))
    return quantile_tables(cut_lineage(qs), cap_q)


def quantile_tables(qs: DataFrame, cap_q: float) -> dict:
    """The quantiles (kind, a, b, c, q, value) by their use."""
    impute_med = qs.where((F.col("kind") == "impute") & (F.col("q") == 0.5)).select(
        F.col("a").alias("TYPE_VEHICLE"), F.col("b").alias("MAKE"), F.col("value").alias("PROD_YEAR_fill"))
    default_med = qs.where((F.col("kind") == "default") & (F.col("q") == 0.5)).select(
        F.col("a").alias("col"), F.col("value").alias("num_value"))
    caps = qs.where((F.col("kind") == "cap") & (F.col("q") == F.lit(cap_q))).select(
        (F.col("a") == "true").alias(SEG), F.col("b").alias("col"), F.col("c").alias("vt"), F.col("value").alias("cap"))
    return {"impute": impute_med, "defaults": default_med, "caps": caps}
