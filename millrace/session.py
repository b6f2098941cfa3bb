"""Session settings and the shared scratch folder.

Nothing here starts a cluster. ``configure`` only sets runtime SQL options that the
operators rely on, and ``materialise`` cuts lineage by writing a table to the folder
that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split into several tasks, also where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators are designed for."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "*", app_name: str = "millrace", **settings: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def local_frame(spark: SparkSession, columns: dict[str, list | pa.Array]) -> DataFrame:
    """A small frame from driver values, whose exact size the optimizer knows.

    That lets Spark decide by itself whether a lookup is small enough to broadcast.
    """
    return spark.createDataFrame(pa.table(columns))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"Set {CHECKPOINT_SETTING} to a folder that every executor can reach."
            )
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(CHECKPOINT_SETTING, root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no other call gets."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no frame needs them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and return the stored copy.

    Used where a plan is read more than once and has to give the same rows each time
    (a sampled range partitioning, for one), and so that a lost executor costs no more
    than the tasks it was running.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def remove(frame: DataFrame) -> None:
    """Delete a stored copy that ``materialise`` returned, once nothing reads it any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(frame: DataFrame) -> int:
    """The size of a stored copy that ``materialise`` returned."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
