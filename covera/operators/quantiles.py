"""Exact ranks and quantiles without sending a group to one task.

For ranks, values are first reduced to (group, value, count) with a partial
aggregate, then ranked with :func:`covera.operators.scan.prefix_scan`, which
splits even a group that holds every row across many tasks.  Quantiles need the
rank of a few values only and are narrowed down by counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covera.operators.joins import checked_broadcast
from covera.operators.scan import prefix_scan
from covera.session import cut_lineage


def value_counts(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    return (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt")))


def value_ranks(df: DataFrame, value: str, groups: list[str], counted: bool = False) -> DataFrame:
    """per (group, value): cnt, below (rows with a smaller value), avg_rank.

    avg_rank is the 1-based rank of the value with ties averaged:
    below + (cnt + 1) / 2.  With ``counted=True`` the input is already
    (groups, value, cnt).
    """
    vc = df if counted else value_counts(df, value, groups)
    ranked = prefix_scan(vc, groups, [value], sums=["cnt"], index=False)
    return ranked.select(
        *groups, value, "cnt",
        (F.col("cnt_cum") - F.col("cnt")).alias("below"),
        (F.col("cnt_cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"),
    )


#: Buckets per factor of e in the first pass of :func:`exact_quantiles`, and pieces of an interval in the later ones.
_FINE, _PIECES = 512, 4096


def exact_quantiles(df: DataFrame, value: str, groups: list[str], qs: list[float],
                    out: str = "quantile", counted: bool = False, stored: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group: long table (groups, q, out).

    ``counted``: the rows are (groups, value, cnt) already.  ``stored``: ``df`` reads a written table, and is read twice instead
    of written.  Nulls and NaN are skipped.  Position (n - 1) * q, value between the order statistics below and above it.

    Nothing is sorted.  The rows are counted by buckets that keep the order of the values (a few thousand per group, added up
    before they are shuffled); the bucket that holds an order statistic is an interval, whose rows are cut into finer pieces
    until it holds one value.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v))
    for g in groups:  # like a pandas group-by, a null group key forms no group
        rows = rows.where(F.col(g).isNotNull())
    # Names of its own; adding zero makes -0.0 equal to 0.0.
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = rows.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], (v + F.lit(0.0)).alias("v"),
                       F.col("cnt").cast("long").alias("cnt") if counted else F.lit(1).cast("long").alias("cnt"))
    rows = rows if stored else cut_lineage(rows)
    held = [F.sum("cnt").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    # The logarithm of the least double is above -746: all exponents have buckets of their own, zero too.
    bucket = F.coalesce(F.floor(F.signum("v") * (F.log(F.abs("v")) + 746) * _FINE), F.lit(0).cast("long"))
    hist = cut_lineage(rows.groupBy(*keys, bucket.alias("piece")).agg(*held))
    # One row per (group, q), and one per order statistic that is looked for.
    pos = (hist.groupBy(*keys).agg(F.sum("n").alias("_n"))
           .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
           .withColumn("_p", (F.col("_n") - 1) * F.col("q"))
           .withColumn("_lo", F.floor("_p")).withColumn("_hi", F.ceil("_p")))
    pos = cut_lineage(pos)
    open_ = pos.select(*keys, F.explode(F.array("_lo", "_hi")).alias("k")).distinct().withColumn("at", F.lit(0).cast("long"))
    hist, found = hist.withColumn("at", F.lit(0).cast("long")), None
    while True:
        # ``at``: rows of the group below the interval, which also names it.
        w = Window.partitionBy(*keys, "at").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = hist.withColumn("top", F.col("at") + F.sum("n").over(w))
        hit = upto.join(checked_broadcast(open_, open_.count()), [*keys, "at"]).where(
            (F.col("k") < F.col("top")) & (F.col("k") >= F.col("top") - F.col("n")))
        hit = cut_lineage(hit.select(*keys, "k", (F.col("top") - F.col("n")).alias("at"), "lo", "hi"))
        here = hit.where("lo = hi").select(*keys, "k", F.col("lo").alias("v"))
        found = here if found is None else found.unionByName(here)
        open_ = hit.where("lo < hi").select(*keys, "k", "at")
        spans = hit.where("lo < hi").select(*keys, "at", "lo", "hi").distinct()
        n = spans.count()
        if not n:
            break
        # Intervals of a group have no value in common.
        rows = rows.select(*keys, "v", "cnt").join(checked_broadcast(spans, n), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        rows = cut_lineage(rows)
        piece = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _PIECES)
        hist = cut_lineage(rows.groupBy(*keys, "at", piece.alias("piece")).agg(*held))
    side = lambda c: found.select(*keys, F.col("k").alias(f"_{c}"), F.col("v").alias(f"_v{c}"))
    res = pos.join(side("lo"), [*keys, "_lo"]).join(side("hi"), [*keys, "_hi"])
    frac = F.col("_p") - F.col("_lo")
    return res.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "q",
                      (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias(out))


def exact_quantile_wide(df: DataFrame, value: str, groups: list[str], q: float, out: str) -> DataFrame:
    return exact_quantiles(df, value, groups, [q], out).drop("q")


# --- Sketches, where an error in rank is acceptable ------------------------------------------------
#: Size of a sketch: accuracy grows with it, and so do the bytes of a group.
SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """The error in rank, as a share of a group's rows, that a KLL sketch keeps to with 99% confidence."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, value: str, groups: list[str], k: int = SKETCH_K) -> DataFrame:
    """(groups, n, sketch): one KLL sketch per group, in one partial aggregate.

    What is shuffled is a sketch per task and group, whatever the rows, and
    nothing is sorted or ranked.  Nulls and NaN are skipped; null group keys
    form no group.  The table can be stored and merged with later ones.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                     F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Sketch tables of several batches as one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, groups: list[str], qs: list[float], out: str = "quantile") -> DataFrame:
    """Long table (groups, q, out): a value whose rank is off by at most :func:`rank_error`, not interpolated."""
    asked = F.array(*[F.lit(float(q)) for q in qs])
    found = sketches.select(*groups, F.explode(F.arrays_zip(
        asked.alias("q"), F.kll_sketch_get_quantile_double("sketch", asked).alias("x"))).alias("_s"))
    return found.select(*groups, F.col("_s.q").alias("q"), F.col("_s.x").alias(out))


def sketch_quantiles(df: DataFrame, value: str, groups: list[str], qs: list[float], out: str = "quantile",
                     k: int = SKETCH_K) -> DataFrame:
    """:func:`exact_quantiles` by sketches."""
    return quantiles_of(quantile_sketches(df, value, groups, k), groups, qs, out)
