import tempfile

from pyspark.sql import functions as F

from covera.operators import state
from covera.plans.processor import PolicyProcessorModel, ProcessorParams, fixture_processor
from covera.sources import policy_io
from covera.sources.fixtures import FIXTURE_TIE, policies

SF = "/root/testdata/sf0.001"


def test_processor_fit_save_load_and_state_versions(spark):
    raw = policies(spark, SF)
    params = ProcessorParams(min_confidence=0.85, cap_inclusive=True)
    model = fixture_processor(spark, FIXTURE_TIE, params).fit(raw)
    assert model.caps_scalar[(True, "PREMIUM")] is not None
    assert model.merges.where("seq < 0").count() == 0
    path = tempfile.mkdtemp(prefix="covera-artefacts-")
    model.save(path)
    again = PolicyProcessorModel.load(spark, path)
    assert again.params == params and again.tie == model.tie and again.defaults == model.defaults
    for table in ("merges", "rules"):
        text = lambda m: sorted(map(repr, getattr(m, table).collect()))
        assert text(again) == text(model)
    a = model.transform(raw, True)
    b = again.transform(raw, True)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    # A loaded model saved to where it came from is a new version; both stay readable.
    again.save(path)
    assert len(policy_io.versions(spark, path)) == 2
    assert PolicyProcessorModel.load(spark, path).transform(raw, True).count() == a.count()
    # State store: every save is a new version; the previous one stays readable.
    st = state.build_state(a, FIXTURE_TIE)
    base = tempfile.mkdtemp(prefix="covera-state-")
    p1 = policy_io.save_state(st, base, version="1")
    p2 = policy_io.save_state(st.withColumn("TOTAL_DURATION", F.col("TOTAL_DURATION") + 1), base, version="2")
    s1, s2 = policy_io.load_state(spark, p1), policy_io.load_state(spark, p2)
    assert s1.count() == s2.count() == st.count()
    assert s2.agg(F.sum("TOTAL_DURATION")).first()[0] == s1.agg(F.sum("TOTAL_DURATION")).first()[0] + st.count()
    assert policy_io.versions(spark, base) == [1, 2]
    assert policy_io.latest_state(spark, base).count() == st.count()
    assert policy_io.latest_state(spark, base, before=2).exceptAll(s1).count() == 0
    assert policy_io.latest_state(spark, base, before=1) is None
    assert policy_io.versions(spark, base + "/none") == []
