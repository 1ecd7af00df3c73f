import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from covera.operators.quantiles import exact_quantiles, value_ranks
from covera.operators.scan import prefix_scan


def skewed(spark):
    # Key 1 holds most rows (a hot object); the others are small.
    rows = [(1, i, float(i % 7)) for i in range(3000)] + [(k, i, float(i)) for k in range(2, 40) for i in range(5)]
    return spark.createDataFrame(rows, "k long, o long, x double")


def test_scan_equals_pandas(spark):
    df = skewed(spark)
    out = prefix_scan(df.repartition(8), ["k"], ["o"], sums=["x"], lags=["x"], firsts=["x"])
    assert dict(out.dtypes)["_idx"] == "bigint"
    b = out.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    a = df.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    g = a.groupby("k").x
    assert (b._idx == a.groupby("k").cumcount()).all() and np.allclose(b.x_cum, g.cumsum())
    assert np.allclose(b.x_first, g.transform("first")) and b.x_prev.isna().equals(g.shift().isna())
    assert np.allclose(b.x_prev.fillna(-1), g.shift().fillna(-1))


def test_value_ranks_match_pandas_average_rank(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 500), "v": rng.integers(0, 40, 500).astype(float)})
    ranks = value_ranks(spark.createDataFrame(pdf), "v", ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        expect = part.assign(r=part.v.rank()).groupby("v").r.first()
        got = ranks[ranks.g == g].set_index("v").avg_rank
        assert np.allclose(got.sort_index().values, expect.sort_index().values)


def test_exact_quantiles_linear(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 301), "v": rng.normal(size=301)})
    q = exact_quantiles(spark.createDataFrame(pdf), "v", ["g"], [0.0, 0.25, 0.5, 0.99, 1.0], "x").toPandas()
    for (g, qq), x in q.set_index(["g", "q"]).x.items():
        assert abs(x - pdf[pdf.g == g].v.quantile(qq)) < 1e-9


def test_exact_quantiles_of_odd_values(spark):
    rng = np.random.default_rng(11)
    values = {"wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500))]),
              "close": 1e6 + rng.integers(0, 10**6, 3000) / 2.0 ** 30, "tiny": rng.uniform(-1e-6, 1e-6, 999),
              "same": np.full(50, -3.5), "one": np.array([7.0]), "zeros": np.array([-0.0, 0.0, 0.0, 5e-324]),
              "ends": np.array([-np.inf, -1.0, 2.0, np.inf, np.inf])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.3, 0.5, 0.99, 1.0]
    given = df.groupBy("g", "v").count().withColumnRenamed("count", "cnt")
    found = exact_quantiles(given, "v", ["g"], qs, "x", counted=True).collect()
    assert len(found) == len(values) * len(qs)
    for r in found:
        order = np.sort(values[r.g])
        at = (len(order) - 1) * r.q
        lo, hi = float(order[int(np.floor(at))]), float(order[int(np.ceil(at))])
        with np.errstate(invalid="ignore", over="ignore"):
            expect = lo + (np.float64(hi) - lo) * (at - np.floor(at))
        assert r.x == expect or (np.isnan(expect) and np.isnan(r.x)), (r, expect)


def test_exact_quantiles_write_no_ranked_rows(spark, tmp_path, monkeypatch):
    from covera.operators import quantiles, scan
    written = []
    for module in (quantiles, scan):
        def cut(df, keep=False, real=module.cut_lineage):
            out = real(df, keep)
            written.append(out.count())
            return out
        monkeypatch.setattr(module, "cut_lineage", cut)
    spark.range(60_000).selectExpr("'g' as g", "sqrt(id + 1.0D) as v").write.parquet(f"{tmp_path}/t")
    found = exact_quantiles(spark.read.parquet(f"{tmp_path}/t"), "v", ["g"], [0.5, 0.99], "x", stored=True).collect()
    order = np.sqrt(np.arange(60_000) + 1.0)
    for r in found:
        assert abs(r.x - np.quantile(order, r.q)) < 1e-9
    assert max(written) < 6_000
