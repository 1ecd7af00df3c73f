"""The `policies` view over the driver tables (lineitem x part), on Spark.

Every policy row is derived from one lineitem row (two for every 20th part,
the `dup_seq` copy), so the view grows with the data.  The matching DuckDB
text lives in :mod:`covera.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row key of the view: breaks every sort tie deterministically.
FIXTURE_TIE = ["l_linenumber", "l_partkey", "l_suppkey", "dup_seq"]

_POLICY_EXPRS = [
    "l_orderkey AS OBJECT_ID",
    "l_linenumber % 3 AS SEX",
    "upper(date_format(add_months(l_shipdate, 144), 'dd-MMM-yy')) AS INSR_BEGIN",
    "upper(date_format(add_months(l_shipdate, 144 + l_linenumber * 3 - 3 + 6 * dup_seq), 'dd-MMM-yy')) AS INSR_END",
    "CASE WHEN l_suppkey % 10 < 6 THEN 1202 WHEN l_suppkey % 10 < 9 THEN 1201 ELSE 1204 END AS INSR_TYPE",
    "CASE WHEN l_returnflag = 'R' THEN 0.0D WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice * 10 END AS INSURED_VALUE",
    "CASE WHEN l_quantity = 49 THEN NULL ELSE l_extendedprice * (0.01D + l_discount) END AS PREMIUM",
    "CASE WHEN p_size = 7 THEN NULL ELSE CAST(1984 + p_size % 30 AS DOUBLE) END AS PROD_YEAR",
    "CASE WHEN l_quantity = 48 THEN NULL ELSE CAST(1 + p_size % 12 AS DOUBLE) END AS SEATS_NUM",
    "CASE WHEN p_size % 6 = 0 THEN 0.0D ELSE CAST(p_size * 100 AS DOUBLE) END AS CCM_TON",
    """CASE p_type WHEN 'ECONOMY' THEN 'Truck' WHEN 'STANDARD' THEN 'Automobile' WHEN 'PROMO' THEN 'Pick-up'
        WHEN 'SMALL' THEN 'Motor-cycle' WHEN 'LARGE' THEN 'Bus' ELSE 'Trade plates' END AS TYPE_VEHICLE""",
    """CASE p_brand WHEN 'Brand#1' THEN 'toyota' WHEN 'Brand#2' THEN 'T0Y0TA' WHEN 'Brand#3' THEN 'Land Rover'
        WHEN 'Brand#4' THEN 'vw' WHEN 'Brand#5' THEN 'Volkswagen' WHEN 'Brand#6' THEN 'ISUSU'
        WHEN 'Brand#7' THEN 'BAJAJI' WHEN 'Brand#8' THEN NULL WHEN 'Brand#9' THEN 'KAMZ' ELSE p_brand END AS MAKE""",
    """CASE WHEN l_suppkey % 10 = 0 THEN 'General Cartage' WHEN l_linestatus = 'F' THEN 'Own Goods'
        ELSE 'Private' END AS USAGE""",
    "l_linenumber", "l_partkey", "l_suppkey", "dup_seq",
]


def policies(spark: SparkSession, sf_dir: str, splits: int | None = None) -> DataFrame:
    """Raw policy rows (section 1.1 schema plus the row key).

    ``splits``: deal the scanned rows to so many tasks, for an input that is one row group
    (a scan has one task per row group at most); by default they stay as they are read.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li if splits is None else li.repartition(splits)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand", "p_size")
    # Every 20th part is listed twice (a longer second contract); an explode of
    # a one- or two-element array keeps this a narrow projection, no join.
    copies = F.when(F.col("l_partkey") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (li.join(part, li.l_partkey == part.p_partkey)
              .withColumn("dup_seq", F.explode(copies)))
    return rows.selectExpr(*_POLICY_EXPRS)


# The hand-written make map of the fixture (raw key -> canonical).
FIXTURE_MAKE_MAP = [
    ("TOYOTA", "TOYOTA"), ("T0Y0TA", "TOYOTA"), ("LANDROVER", "LAND ROVER"),
    ("VW", "VOLKSWAGEN"), ("VOLKSWAGEN", "VOLKSWAGEN"), ("ISUSU", "ISUZU"),
    ("BAJAJI", "BAJAJ"), ("KAMZ", "KAMAZ"),
]

# Hand-set category merges (applied in this order, so they chain).
FIXTURE_MERGES = [
    # (is_zero, column, seq, old, new)
    (True, "USAGE", 0, "Own Goods", "Private"),
    (True, "USAGE", 1, "Private", "General Cartage"),
    (False, "USAGE", 0, "Own Goods", "Private"),
    (False, "USAGE", 1, "Private", "General Cartage"),
]

# Hand-set rules for the rule-miss and correction checks.
FIXTURE_RULES = [
    # (is_zero, seq, antecedents, consequent, confidence)
    (False, 0, {"USAGE": "Private"}, {"INSR_TYPE": "1202"}, 0.998),
    (True, 0, {"USAGE": "Private"}, {"INSR_TYPE": "1202"}, 0.9),
    (True, 1, {"USAGE": "General Cartage", "TYPE_VEHICLE": "Truck"}, {"INSR_TYPE": "1201"}, 0.999),
]


def literal_table(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    """A small fixed table as a plan literal (Catalyst knows its size and broadcasts it)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def make_map_table(spark: SparkSession, pairs=None) -> DataFrame:
    """Make map as a (raw, canonical) table."""
    pairs = FIXTURE_MAKE_MAP if pairs is None else pairs
    return literal_table(spark, pairs, ["raw", "canonical"])
