"""Policy sources and sinks: A1-A5, A7, A9.

Batches are read by column *name* (a CSV's column order does not matter),
each file by its own header, its first line; one scan serves all files of one
header.  Cells are typed with try_cast (a junk cell becomes null;
:func:`cast_failures` counts them) and rows numbered in file order
(``_row_id``), so that every later sort has a deterministic last tie-breaker.  Stores are parquet; every overwrite goes to
a new version folder, so no job ever reads and overwrites the same path.
"""

from __future__ import annotations

import csv
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covera.operators.joins import checked_broadcast
from covera.schema import CORE_TYPES, ROW_ID
from covera.session import cut_lineage

OPTIONAL = {"PREMIUM", "EFFECTIVE_YR", "CLAIM_PAID", "CARRYING_CAPACITY"}


def type_policies(df: DataFrame) -> DataFrame:
    """Cast the known columns by name; unknown columns stay as they are."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in CORE_TYPES.items() if c in df.columns})


def file_heads(lines: DataFrame) -> DataFrame:
    """(file, head): the first line with any text of every file of ``lines`` (:func:`text_lines`).

    Only the first block of a file is looked at.
    """
    first = lines.where((F.col("_block") == 0) & (F.trim("value") != ""))
    return first.groupBy(F.col("_file").alias("file")).agg(F.min_by("value", "_at").alias("head"))


def text_lines(spark: SparkSession, path) -> DataFrame:
    """Every line of the files, with its file, the block it is read in and its place in the scan."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                        F.col("_metadata.file_block_start").alias("_block"),
                                        F.monotonically_increasing_id().alias("_at"))


def header_names(head: str, file: str) -> list[str]:
    names = [n.strip() for n in next(csv.reader([head.lstrip("\ufeff")]))]
    if "OBJECT_ID" not in names:
        raise ValueError(f"{file} is without header")
    if len({n for n in names if n}) < len(names):
        raise ValueError(f"{file} has columns without a name of their own")
    return names


def scan_csv(spark: SparkSession, heads: list[tuple[str, str]]) -> DataFrame:
    """The rows of CSV files, given as (file, head), by the names of their headers; all cells are text.

    A header is the first line of its file, whatever any other line holds.
    Files with the same header are one scan, so there are as many scans as
    headers.  A column that a file lacks is null, and so are the last cells of
    a short line; a line with more cells than its header fails the job.
    """
    groups: dict = {}
    for file, head in sorted(heads):
        groups.setdefault(tuple(header_names(head, file)), []).append(unquote(file))
    out = None
    for names, files in groups.items():
        more = "_more"
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, more)])
        rows = (spark.read.schema(schema).csv(files, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True,
                                              ignoreTrailingWhiteSpace=True)
                .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
                .withColumn("_at", F.monotonically_increasing_id()))
        sound = F.when(F.col(more).isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("a line with more cells than its header in "), F.col("_file"))).cast("boolean"))
        rows = rows.where(sound).select("_file", "_block", "_at", *[F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def number_rows(rows: DataFrame) -> DataFrame:
    """``_row_id`` from 0 in the order of file name and line, for written ``rows`` of :func:`scan_csv`.

    A block of a file is read by one task, in order; one row per block tells
    how many rows come before it.
    """
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = cut_lineage(blocks.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_first",
                                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    side = checked_broadcast(offset, offset.count())
    at = F.col("_before") + F.col("_at") - F.col("_first")
    joined = rows.join(side, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(ROW_ID, at).drop("_file", "_block", "_at", "_f", "_b", "_first", "_before")


def read_files(spark: SparkSession, heads: list[tuple[str, str]]) -> DataFrame:
    """Text cells of the files by name, numbered in file order; written once, so that the numbers stay."""
    if not heads:
        return spark.createDataFrame([], f"OBJECT_ID string, {ROW_ID} long")
    return number_rows(cut_lineage(scan_csv(spark, heads)))


def read_csv_text(spark: SparkSession, path) -> DataFrame:
    """Header CSVs as text cells by name, with a file-order row id."""
    return read_files(spark, [tuple(r) for r in file_heads(text_lines(spark, path)).collect()])


def read_policies_csv(spark: SparkSession, path) -> DataFrame:
    """A1: header CSVs -> typed policy rows by name, with a file-order row id."""
    return type_policies(read_csv_text(spark, path))


def cast_failures(raw: DataFrame) -> DataFrame:
    """(col, value): per known column how many non-empty cells do not have its type (they are read as null)."""
    known = [c for c in CORE_TYPES if c in raw.columns]
    row = raw.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(CORE_TYPES[c]).isNull()).alias(c) for c in known])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in known])).alias("s")) \
        .select("s.*")


def check_batch(df: DataFrame, labelled: bool) -> None:
    """Schema check from the plan only (no job): every core column present."""
    need = set(CORE_TYPES) - OPTIONAL | ({"PREMIUM"} if labelled else set())
    missing = sorted(need - set(df.columns))
    if missing:
        raise ValueError(f"batch lacks columns {missing}")


def route(df: DataFrame) -> str:
    """A5: a batch with PREMIUM is training data ('store'), else it is predicted."""
    return "store" if "PREMIUM" in df.columns else "predict"


def store_columns() -> list[str]:
    return list(CORE_TYPES)


def append_labelled(df: DataFrame, store: str, batch: str | None = None) -> str:
    """A2: append a labelled batch to the training store, by name (Q11); returns the batch's folder.

    A named batch is written by overwrite, so that a replay does not add it twice.
    """
    check_batch(df, labelled=True)
    out = df.select(*[F.col(c).cast(t).alias(c) for c, t in CORE_TYPES.items()])
    path = f"{store.rstrip('/')}/batch={batch or 'b' + uuid.uuid4().hex}"
    out.write.mode("overwrite" if batch else "errorifexists").parquet(path)
    return path


def overwrite_store(df: DataFrame, base: str, version: str | None = None) -> str:
    """A3: write a whole new version of the store; returns its path."""
    path = f"{base.rstrip('/')}/v={version or int(time.time() * 1000)}"
    df.select(*[F.col(c).cast(t).alias(c) for c, t in CORE_TYPES.items() if c in df.columns]) \
      .write.mode("errorifexists").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the store with a row id; written once, so that the ids are the same in every later scan."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return cut_lineage(rows.withColumn(ROW_ID, F.monotonically_increasing_id()))


def write_predictions(df: DataFrame, input_path: str, fmt: str = "csv") -> str:
    """A4: input columns + predicted_premium, next to the input with a `_predicted` suffix."""
    stem = input_path.rstrip("/")
    dot = stem.rfind(".")
    out = (stem[:dot] + "_predicted" + stem[dot:]) if dot > stem.rfind("/") else stem + "_predicted"
    writer = df.drop(ROW_ID).write.mode("errorifexists")
    (writer.option("header", True).csv(out) if fmt == "csv" else writer.parquet(out))
    return out


def save_state(state: DataFrame, base: str, version: str | int | None = None) -> str:
    """Object state as a new parquet version; writing a version again replaces it (a replayed batch)."""
    path = f"{base.rstrip('/')}/v={int(time.time() * 1000) if version is None else version}"
    state.select("OBJECT_ID", "is_zero", F.col("PREVIOUS_PREMIUM").cast("double"),
                 F.col("TOTAL_DURATION").cast("long")).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions ``v=<number>`` under a folder, in order (through Hadoop's file system, any store)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName()[2:]) for p in found
                  if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The newest committed state version (older than ``before``), or None."""
    found = [v for v in versions(spark, base) if before is None or v < before]
    return load_state(spark, f"{base.rstrip('/')}/v={found[-1]}") if found else None


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate between stages and continue from the files."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def new_version(spark: SparkSession, base: str, version: int | None = None) -> str:
    """Path of a new version folder; it counts as committed only after :func:`commit_version`."""
    path = f"{base.rstrip('/')}/v={int(time.time() * 1000) if version is None else version}"
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        raise ValueError(f"{path} exists")
    return path


def commit_version(spark: SparkSession, path: str) -> None:
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
