"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tablewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="tablewise-")
    return _local_folders[application]


_local_folders: dict[str, str] = {}


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from there.

    The lineage is cut, lost executors lose nothing, later readers prune columns, and the
    size of the result is known from its files.
    """
    path = f"{shared_folder(df.sparkSession)}/tablewise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reused(df: DataFrame) -> DataFrame:
    """A frame that several aggregates read, materialised once where more than one input stands behind it.

    A plain scan is read again instead, since its columns are pruned at the source.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return reliable_checkpoint(df) if leaves.size() > 1 else df
