from pyspark.sql import functions as F

from covera.operators import clean, state
from covera.sources.fixtures import make_map_table
from tests.conftest import policy_rows, row

TIE = ["_row_id"]


def cleaned(spark, rows, train=True):
    return clean.base_clean(policy_rows(spark, rows), clean.make_lookup(make_map_table(spark)), train, TIE)


def history_rows():
    return [row(OBJECT_ID=1, INSR_BEGIN=f"01-JAN-{y}", INSR_END=f"01-JAN-{y + 1}", PREMIUM=float(p), _row_id=y)
            for y, p in [(10, 100), (11, 110), (12, 120), (13, 130)]] + [
        row(OBJECT_ID=2, INSURED_VALUE=0.0, PREMIUM=50.0, _row_id=50)]


def test_build_state_and_history(spark):
    k1 = cleaned(spark, history_rows())
    st = {(r.OBJECT_ID, r.is_zero): r for r in state.build_state(k1, TIE).collect()}
    assert st[(1, False)].PREVIOUS_PREMIUM == 130.0 and st[(1, False)].TOTAL_DURATION == 48
    assert st[(2, True)].TOTAL_DURATION == 12
    h = state.policy_history(k1, TIE)
    assert state.first_policies(h).count() == 2
    ref = state.later_history(h, "skip_first").orderBy("START_MNTH").collect()
    full = state.later_history(h, "full").orderBy("START_MNTH").collect()
    # skip_first: the second policy has no lag and is lost; totals leave the first policy out
    assert [(r.PREVIOUS_PREMIUM, r.TOTAL_DURATION) for r in ref] == [(110.0, 24), (120.0, 36)]
    assert [(r.PREVIOUS_PREMIUM, r.TOTAL_DURATION) for r in full] == [(100.0, 24), (110.0, 36), (120.0, 48)]


def test_split_fold_and_update(spark):
    st = state.build_state(cleaned(spark, history_rows()), TIE)
    batch = cleaned(spark, [
        row(OBJECT_ID=1, INSR_BEGIN="01-JAN-14", INSR_END="01-JUL-14", _row_id=1),    # known object twice
        row(OBJECT_ID=1, INSR_BEGIN="01-JUL-14", INSR_END="01-JAN-15", _row_id=2),
        row(OBJECT_ID=3, INSR_BEGIN="01-JAN-14", INSR_END="01-JAN-15", _row_id=3),    # new object twice
        row(OBJECT_ID=3, INSR_BEGIN="01-FEB-14", INSR_END="01-MAR-14", _row_id=4),
    ], train=False)
    split = state.split_by_state(batch, st).orderBy("_row_id").collect()
    assert [r.KNOWN for r in split] == [True, True, False, False]
    assert [r.TOTAL_DURATION for r in split[:2]] == [54, 54]       # state total + this row only
    pred = batch.withColumn("prediction", F.col("_row_id").cast("double") * 10)
    folded = {r.OBJECT_ID: r for r in state.fold_predictions(st, pred, TIE).collect()}
    assert (folded[1].PREVIOUS_PREMIUM, folded[1].TOTAL_DURATION) == (20.0, 60)
    assert (folded[3].PREVIOUS_PREMIUM, folded[3].TOTAL_DURATION) == (40.0, 1)   # last row's duration only
    assert (folded[2].PREVIOUS_PREMIUM, folded[2].TOTAL_DURATION) == (50.0, 12)  # untouched
    upd = {r.OBJECT_ID: r for r in state.update_with_labels(st, batch, TIE).collect()}
    assert upd[1].TOTAL_DURATION == 6 and upd[1].PREVIOUS_PREMIUM == 100.0        # overwritten, not added
