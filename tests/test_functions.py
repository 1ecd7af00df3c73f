import math

from pyspark.sql import functions as F

from covera.functions.columns import MONTHS, is_zero, make_key, month_index
from covera.functions.pvalues import chi2_sf, normal_two_sided


def test_month_index_every_month(spark):
    dates = [(f"15-{m}-13",) for m in MONTHS] + [("15-XYZ-13",)]
    out = spark.createDataFrame(dates, "d string").select(month_index("d").alias("m")).collect()
    assert [r.m for r in out[:12]] == [13 * 12 + i for i in range(12)]
    assert out[12].m is None


def test_make_key_and_segment(spark):
    df = spark.createDataFrame([(" Land Rover ", 0.0), (None, None), ("vw", 5.0)], "m string, v double")
    got = df.select(make_key("m").alias("k"), is_zero("v").alias("z")).collect()
    assert [r.k for r in got] == ["LANDROVER", "", "VW"]
    assert [r.z for r in got] == [True, False, False]  # null is not zero


def test_pvalue_helpers():
    assert abs(normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(chi2_sf(5.991465, 2) - 0.05) < 1e-6
    assert abs(chi2_sf(7.814728, 3) - 0.05) < 1e-6
    assert chi2_sf(0.0, 4) == 1.0
    assert math.isnan(chi2_sf(float("nan"), 2))
