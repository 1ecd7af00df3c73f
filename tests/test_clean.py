from pyspark.sql import functions as F

from covera.operators import clean
from covera.sources.fixtures import make_map_table
from tests.conftest import policy_rows, row


def lookup(spark):
    return clean.make_lookup(make_map_table(spark))


def test_base_clean_train_edge_cases(spark):
    rows = [
        row(OBJECT_ID=None, _row_id=1),                                             # null object: dropped
        row(OBJECT_ID=2, INSR_END="01-JAN-10", _row_id=2),                          # negative duration
        row(OBJECT_ID=3, INSR_END="01-JUN-11", _row_id=3),                          # same contract, shorter
        row(OBJECT_ID=3, INSR_END="01-JAN-12", _row_id=4),                          # same contract, longest: kept
        row(OBJECT_ID=4, INSURED_VALUE=None, _row_id=5),                            # null identity cell...
        row(OBJECT_ID=4, INSURED_VALUE=None, _row_id=6),                            # ...equal nulls: one kept (last)
        row(OBJECT_ID=5, PREMIUM=None, _row_id=7),                                  # null premium: dropped
        row(OBJECT_ID=6, TYPE_VEHICLE="Trade plates", PROD_YEAR=None, MAKE="T0Y0TA", _row_id=8),
        row(OBJECT_ID=7, MAKE="Brand#99", _row_id=9),
    ]
    out = clean.base_clean(policy_rows(spark, rows), lookup(spark), True, ["_row_id"]).orderBy("OBJECT_ID").collect()
    assert [r.OBJECT_ID for r in out] == [3, 4, 6, 7]
    by = {r.OBJECT_ID: r for r in out}
    assert 1 not in by and 2 not in by and 5 not in by
    assert by[3].DURATION == 12 and by[3]._row_id == 4
    assert by[4]._row_id == 6
    assert (by[6].CCM_TON, by[6].SEATS_NUM, by[6].PROD_YEAR, by[6].MAKE) == (0.0, 0.0, 2010.0, "TOYOTA")
    assert by[7].MAKE == "UNKNOWN"


def test_dedup_tie_on_duration_uses_row_key(spark):
    rows = [row(OBJECT_ID=9, _row_id=20), row(OBJECT_ID=9, _row_id=21), row(OBJECT_ID=9, _row_id=19)]
    out = clean.base_clean(policy_rows(spark, rows), lookup(spark), True, ["_row_id"]).collect()
    assert len(out) == 1 and out[0]._row_id == 21


def test_inference_keeps_everything_but_null_objects(spark):
    rows = [row(OBJECT_ID=2, INSR_END="01-JAN-10"), row(OBJECT_ID=3, PREMIUM=None), row(OBJECT_ID=3)]
    out = clean.base_clean(policy_rows(spark, rows), lookup(spark), False, ["_row_id"])
    assert out.count() == 3


def test_make_closure_identity_wins(spark):
    mm = make_map_table(spark, [("HOWO", "SINOTRUK"), ("SINOTRUK", "SINOTRUK"), ("X", "HOWO")])
    got = {r.MAKE_KEY: r.MAKE_STD for r in clean.make_lookup(mm).collect()}
    assert got["HOWO"] == "HOWO"          # HOWO is also a canonical value: identity wins
    assert got["X"] == "HOWO" and got["SINOTRUK"] == "SINOTRUK"


def test_filter_on_duration_does_not_parse_the_dates_again(spark):
    rows = [row(OBJECT_ID=2, INSR_END="01-JAN-10"), row(OBJECT_ID=3, INSR_END="01-MAR-11")]
    out = clean.keep_positive_duration(clean.with_months(policy_rows(spark, rows)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "split(" in line]
    assert [(r["OBJECT_ID"], r["START_MNTH"], r["END_MNTH"], r["DURATION"]) for r in out.collect()] == [(3, 132, 134, 2)]
