"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "framewise", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    ``shuffle.partitions`` is left to the cluster; AQE coalesces small partitions and splits
    skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{name: str(value) for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without one, a session on a single machine (master ``local``) gets a
    temporary folder, once; on a cluster that is an error, since executors would not share it."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", context.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not hasattr(context, "_framewise_folder"):
        context._framewise_folder = tempfile.mkdtemp(prefix="framewise-")
    return context._framewise_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and each later use reads only its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and continue from there.

    See ``shared_folder``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
