import numpy as np
from pyspark.sql import functions as F

from covera.operators.quantiles import merge_sketches, quantile_sketches, quantiles_of, rank_error, sketch_quantiles


def skewed(spark):
    """One group holds nine tenths of 200,000 rows, another six rows; ties, nulls, NaN and a null group."""
    rng = np.random.default_rng(4)
    n = 200_000
    group = np.where(rng.random(n) < 0.9, "hot", rng.choice(["b", "c"], n)).astype(object)
    group[:6] = "few"
    value = np.round(rng.gamma(2.0, 100.0, n), 0)
    rows = spark.createDataFrame([(g, float(v)) for g, v in zip(group, value)], "g string, v double")
    odd = spark.createDataFrame([("b", None), ("b", float("nan")), (None, 5.0)], "g string, v double")
    return rows.unionByName(odd).repartition(40), {g: np.sort(value[group == g]) for g in set(group)}


def off(values, found, q):
    """How far the rank of ``found`` is from ``q``, as a share of the rows (0 inside a tie)."""
    below, upto = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(0.0, below - q, q - upto)


def test_rank_error_is_within_the_bound(spark):
    df, values = skewed(spark)
    for k in (200, 4096):
        got = sketch_quantiles(df, "v", ["g"], [0.01, 0.5, 0.99], "x", k).collect()
        assert {r["g"] for r in got} == set(values) and len(got) == 3 * len(values)
        assert all(off(values[r["g"]], r["x"], r["q"]) <= rank_error(k) + 1 / len(values[r["g"]]) for r in got)


def test_stored_sketches_merge(spark, tmp_path):
    df, values = skewed(spark)
    part = F.pmod(F.xxhash64("g", "v"), F.lit(3))
    for i in range(3):
        quantile_sketches(df.where(part == i), "v", ["g"]).write.parquet(str(tmp_path / f"{i}"))
    merged = merge_sketches([spark.read.parquet(str(tmp_path / f"{i}")) for i in range(3)], ["g"])
    assert {r["g"]: r["n"] for r in merged.collect()} == {g: len(v) for g, v in values.items()}
    for r in quantiles_of(merged, ["g"], [0.5, 0.99], "x").collect():
        assert off(values[r["g"]], r["x"], r["q"]) <= rank_error() + 1 / len(values[r["g"]])


def test_processor_fits_from_sketches(spark):
    from covera.plans.processor import ProcessorParams, fixture_processor
    from covera.sources.fixtures import FIXTURE_TIE, policies
    raw = policies(spark, "/root/testdata/sf0.001")
    exact, approx = (fixture_processor(spark, FIXTURE_TIE, ProcessorParams(min_confidence=0.85, sketch_k=k)).fit(raw)
                     for k in (None, 4096))
    assert set(exact.caps_scalar) == set(approx.caps_scalar) and set(exact.defaults) == set(approx.defaults)
    for key, cap in exact.caps_scalar.items():
        assert cap is None or abs(approx.caps_scalar[key] - cap) <= 0.05 * cap
    assert abs(approx.transform(raw, True).count() - exact.transform(raw, True).count()) <= 0.01 * raw.count()
