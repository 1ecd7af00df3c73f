import os

import pytest

from covera.plans import catalog, summaries
from covera.session import cut_lineage, ensure_checkpoint_dir, lineage_scope

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["k8_quality_report", "e16_stage_sizes", "e7_null_counts", "e12_histogram",
                                  "d2_group_impute", "e11_box_stats", "k1_clean_metrics"])
def test_one_scan_of_the_input(spark, monkeypatch, name):
    """The view over lineitem is built once, and nothing of it is left in the final plan."""
    built = []
    view = catalog.fixtures.policies
    monkeypatch.setattr(catalog.fixtures, "policies", lambda *a: built.append(1) or view(*a))
    out = catalog.QUERIES[name](spark, SF)
    assert "l_orderkey" not in plan_of(out)
    assert len(built) == (2 if name == "k8_quality_report" else 1)  # the report's model is learnt first


def test_scope_deletes_what_was_written_inside(spark):
    base = f"{ensure_checkpoint_dir(spark)}/covera-tables".removeprefix("file:")
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    with lineage_scope(spark):
        kept = cut_lineage(spark.range(5), keep=True)
        assert cut_lineage(spark.range(7)).count() == 7
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and kept.count() == 5


def test_same_rows_counts_repeats(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i int, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, s string")
    r = summaries.same_rows(a, b).first()
    assert (r["rows_a"], r["rows_b"], r["only_a"], r["only_b"], r["equal"]) == (3, 3, 1, 1, False)
    assert summaries.same_rows(a, a).first()["equal"] and summaries.same_rows(a.limit(0), b.limit(0)).first()["equal"]


def test_the_quality_report_keeps_one_table_of_rows(spark):
    """It kept the base clean of the fit and wrote the rows of every stage: five tables as long as the input."""
    base = f"{ensure_checkpoint_dir(spark)}/covera-tables".removeprefix("file:")
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    out = catalog.QUERIES["k8_quality_report"](spark, SF)
    counts = {r["metric"]: r["value"] for r in out.collect()}
    left = [spark.read.parquet(f"{base}/{t}").count() for t in set(os.listdir(base)) - before]
    assert len([n for n in left if n > 0.2 * counts["rows_before_dedup"]]) == 1
    assert max(left) >= counts["rows_after_dedup"] > counts["INSR_ZERO_records"] + counts["ELSE_records"] > 0
