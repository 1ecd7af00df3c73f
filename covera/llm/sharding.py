"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within each source.  Row number r of a
source with n rows gets the fractional rank (2r + 1) / 2n, so every source is
spread evenly over (0, 1); all rows are sorted by it and the sorted sequence
is cut into shards whose row counts differ by at most one.  Every shard then
holds each source in its share of the whole, to within one row.

Both sorts are range partitioned over narrow rows (:func:`ordered_scan`), so
a source with a third of all rows is not gathered anywhere.

Defined cases: a null source is a source of its own; a null text has no
bytes (size 8, crc32 0); rows equal in every used column are interchangeable;
fewer rows than shards leave some shards empty; no rows give no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.llm.common import ordered_scan


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("_u", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    # Equal shuffle keys are told apart by all other columns.
    tie = [F.col(c) for c in ("_u", "doc_id", "text_crc32", "size")]
    ranked = ordered_scan(rows, [F.col("source").asc_nulls_first(), *tie])
    strata = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.min("_g").alias("_first"))
    strata = strata.withColumnRenamed("source", "_source")
    spread = ranked.join(strata, F.col("source").eqNullSafe(F.col("_source"))).select(
        *rows.columns,
        ((2 * (F.col("_g") - F.col("_first")) + 1).cast("double") / (2 * F.col("_n"))).alias("_rank"))
    cut = ordered_scan(spread, [F.col("_rank"), F.col("source").asc_nulls_first(), *tie])
    total = docs.count()
    shard = F.expr(f"(_g * {shards}) div {max(total, 1)}")
    # The first row of shard s is the least g with g * shards >= s * total.
    return cut.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_g") - F.expr(f"(cast(shard AS bigint) * {total} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source")
