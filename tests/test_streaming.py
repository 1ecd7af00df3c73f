import os
import tempfile

from pyspark.sql import functions as F

from covera.sources import policy_io
from covera.sources.state_store import StateStore
from covera.streaming.batches import infer_batch, start_collection, start_inference
from test_io import NAMES, policy, write_csv


def test_labelled_files_stream_into_the_store(spark):
    base = tempfile.mkdtemp(prefix="covera-stream-")
    inbox = os.path.join(base, "inbox")
    os.makedirs(inbox)
    write_csv(os.path.join(inbox, "b0.csv"), NAMES, [policy(1)])
    write_csv(os.path.join(inbox, "b1.csv"), ["EFFECTIVE_YR", *reversed(NAMES)], [policy(2, EFFECTIVE_YR=11)])
    q = start_collection(spark, inbox, os.path.join(base, "store"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    store = policy_io.read_store(spark, os.path.join(base, "store"))
    assert {(r["OBJECT_ID"], r["PREMIUM"], r["TYPE_VEHICLE"]) for r in store.collect()} == {(1, 10.5, "Truck"), (2, 21.0, "Truck")}
    assert dict(store.dtypes)["OBJECT_ID"] == "bigint" and dict(store.dtypes)["PREMIUM"] == "double"


def stand_in(spark):
    """Stands in for a fitted model: predicts 2 x SEATS_NUM and folds with the real state operator."""
    from dataclasses import dataclass
    from pyspark.sql import DataFrame
    from covera.operators import state
    from covera.plans.predictor import PremiumPredictorModel

    @dataclass
    class Model(PremiumPredictorModel):
        def predict(self, raw: DataFrame) -> DataFrame:
            known = state.split_by_state(raw.withColumn("is_zero", F.lit(True)).withColumn("DURATION", F.lit(12))
                                         .withColumn("START_MNTH", F.lit(144)), self.state)
            return known.select("_row_id", "OBJECT_ID", "is_zero", "KNOWN", "START_MNTH", "DURATION",
                                (F.col("SEATS_NUM") * 2).alias("prediction"))

    first = spark.createDataFrame([(777, True, 5.0, 12)], "OBJECT_ID long, is_zero boolean, PREVIOUS_PREMIUM double, TOTAL_DURATION long")
    return Model(None, ["_row_id"], ["_row_id"], {}, first)


def total(spark, base, object_id):
    states = StateStore(spark, base)
    return states.read(states.latest()).where(F.col("OBJECT_ID") == object_id).first()["TOTAL_DURATION"]


def test_inference_goes_on_after_a_restart_and_a_replay(spark):
    base = tempfile.mkdtemp(prefix="covera-infer-")
    inbox, out, states, ckpt = (os.path.join(base, d) for d in ("inbox", "out", "state", "ckpt"))
    os.makedirs(inbox)
    names = [n for n in NAMES if n != "PREMIUM"]
    for batch, rows in enumerate([[policy(777), policy(5)], [policy(777)]]):
        write_csv(os.path.join(inbox, f"b{batch}.csv"), names if batch else list(reversed(names)), rows)
        # A new query and a new model object each time: a restart with the same checkpoint.
        start_inference(spark, inbox, stand_in(spark), states, out, ckpt).awaitTermination(180)
        assert total(spark, states, 777) == 24 + 12 * batch
    assert policy_io.versions(spark, states) == [0, 1]
    got = spark.read.parquet(out)
    assert set(names) | {"predicted_premium"} <= set(got.columns) and "_row_id" not in got.columns
    assert sorted(r["predicted_premium"] for r in got.collect()) == [8.0, 8.0, 8.0]
    # Batch 1 once more: the same state, the same rows.
    raw = policy_io.text_lines(spark, os.path.join(inbox, "b1.csv"))
    infer_batch(raw, 1, stand_in(spark), states, out)
    assert total(spark, states, 777) == 36 and spark.read.parquet(out).count() == 3
