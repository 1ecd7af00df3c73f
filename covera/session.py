"""Session helpers: local sessions for tests / bench and the checkpoint folder.

Lineage is cut only with tables written to the folder the
cluster names in ``spark.checkpoint.dir``.  A folder of our own is created
only when the session has none *and* runs in local mode (tests, bench).
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "covera", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session conf.

    Order: the folder already set on the context, then ``spark.checkpoint.dir``
    from the conf, then (local master only) a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    local_dir = tempfile.mkdtemp(prefix="covera-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir


#: Tables of the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def lineage_scope(spark: SparkSession):
    """Tables that :func:`cut_lineage` writes inside are deleted at the end, but for those with ``keep``.

    What is computed from them has to be written or collected inside.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        release(spark, _SCOPES.pop())


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, on whatever store they are."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise as a parquet table in the shared checkpoint folder and read it back.

    One job, the lineage is cut (a lost executor re-reads the files), and
    later reads prune columns.  The table stays until the surrounding
    :func:`lineage_scope` ends, or with ``keep`` until the folder is cleared.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/covera-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
