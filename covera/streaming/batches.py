"""Incoming policy files as a stream (the CLI's inference mode, file by file).

The stream tells which files are new; every micro-batch reads them by their
own headers, so column order and extra columns may differ from file to file.  Labelled files are appended to the training store (A2); unlabelled
ones are predicted with the fitted model, written as input columns plus
``predicted_premium`` (A4), and folded into a new state version (N3): a run of
the rows they touch.

Every output of a batch goes to a folder named by the batch id and is
written by overwrite, and a batch starts from the newest state version before
its own, so a replayed batch gives the same files again and a restart goes on
from the stored state.  A state folder belongs to one checkpoint folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covera.schema import CORE_TYPES, ROW_ID
from covera.session import cut_lineage, lineage_scope
from covera.sources import policy_io
from covera.sources.state_store import StateStore


def policy_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the CSV files that arrive in ``folder``, with their file and block."""
    return spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("_file"),
                                                F.col("_metadata.file_block_start").alias("_block"))


def batch_rows(batch: DataFrame) -> DataFrame:
    """Typed rows of a micro-batch with a row id: its files, read by their headers."""
    lines = batch.withColumn("_at", F.monotonically_increasing_id())
    heads = [tuple(r) for r in policy_io.file_heads(lines).collect()]
    rows = policy_io.read_files(batch.sparkSession, heads)
    missing = [F.lit(None).cast("string").alias(c) for c in CORE_TYPES if c not in rows.columns]
    return policy_io.type_policies(rows.select("*", *missing))


def infer_batch(batch: DataFrame, batch_id: int, model, state_base: str, out_folder: str) -> None:
    """Predict one micro-batch and fold it into the state version ``batch_id``."""
    spark = batch.sparkSession
    with lineage_scope(spark):
        rows = batch_rows(batch).drop("PREMIUM")
        states = StateStore(spark, state_base)
        known = states.latest(before=batch_id)
        now = model if known is None else replace(model, state=states.read(known))
        pred = cut_lineage(now.predict(rows))
        now.with_predictions(rows, pred).drop(ROW_ID).write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")
        now.remember(pred, states, batch_id)


def start_inference(spark: SparkSession, folder: str, model, state_base: str, out_folder: str,
                    checkpoint: str, trigger_once: bool = True):
    """Predict every new unlabelled file; keep the state as versioned parquet."""
    writer = policy_stream(spark, folder).writeStream.foreachBatch(
        lambda batch, batch_id: infer_batch(batch, batch_id, model, state_base, out_folder)) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def start_collection(spark: SparkSession, folder: str, store: str, checkpoint: str, trigger_once: bool = True):
    """A2 as a stream: every new labelled file is appended to the training store, by name."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        with lineage_scope(spark):
            policy_io.append_labelled(batch_rows(batch), store, batch=f"s{batch_id}")

    writer = policy_stream(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
