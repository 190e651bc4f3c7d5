"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints whose tables nobody holds any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Plans here have thousands of expressions; recording a call site for each is slow.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "plumbline", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only where none is set.

    Falling back is for local runs alone: on a cluster ``spark.checkpoint.dir``
    has to name a folder every executor can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    scratch = os.environ.get("PLUMBLINE_SCRATCH") or tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where their PYTHONPATH doesn't have it.

    Spark itself hands the archive from the driver to the executors.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_plumbline_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "plumbline")
    context.addPyFile(shutil.make_archive(base, "zip", root, "plumbline"))
    context._plumbline_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and stops plans from growing.

    Also used wherever one result feeds several branches, so the scan behind it
    runs once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def store_by(df: DataFrame, column: str) -> DataFrame:
    """Write rows into the shared folder, one subfolder for each value of ``column``.

    For a table that many branches read by that column: each opens its own subfolder and
    only the columns it needs, where a checkpoint would be read and deserialized whole.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/by-{column}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
