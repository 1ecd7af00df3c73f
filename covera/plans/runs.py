"""Entry points: update the models from the store, and process one incoming batch."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import SparkSession

from covera.plans.predictor import PremiumPredictor, PremiumPredictorModel
from covera.session import cut_lineage
from covera.sources import policy_io
from covera.sources.state_store import StateStore


def update_models(spark: SparkSession, store: str, model_base: str, predictor: PremiumPredictor) -> str:
    """Load the store, fit, save a new model version; returns its path."""
    return predictor.fit(policy_io.read_store(spark, store)).save(model_base)


def process_batch(spark: SparkSession, path: str, store: str, model_base: str, state_base: str,
                  fmt: str = "csv") -> tuple[str, str]:
    """Route a CSV batch: labelled rows go to the store, others are predicted with the newest model.

    Returns ("store", store) or ("predict", path of the predictions).  The
    state after the batch is a new version in ``state_base``.
    """
    batch = policy_io.read_policies_csv(spark, path)
    if policy_io.route(batch) == "store":
        policy_io.append_labelled(batch, store)
        return "store", store
    policy_io.check_batch(batch, labelled=False)
    model = PremiumPredictorModel.load(spark, model_base)
    states = StateStore(spark, state_base)
    known = states.latest()
    model = model if known is None else replace(model, state=states.read(known))
    pred = cut_lineage(model.predict(batch))
    out = policy_io.write_predictions(model.with_predictions(batch, pred), path, fmt)
    model.remember(pred, states, max(int(time.time() * 1000), (known or 0) + 1))
    return "predict", out
