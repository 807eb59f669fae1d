"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster submitters pass their own settings on top."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, taken from ``spark.checkpoint.dir``.

    A folder of our own is set only in local mode with the setting absent, as in tests. On a
    cluster a machine-local folder would not survive an executor loss, so that is refused.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if not root:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set(_CHECKPOINT_CONF, root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "codeloom", f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps read: it cuts the lineage, survives lost executors, and
    later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
