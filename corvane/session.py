"""What a session needs to run the package's code in its Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Workers on this machine find the package wherever the driver was started; on a cluster it is installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; of this machine where a local session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once where several branches read it: a table in the shared folder, so no cache is left behind and lost executors do no harm."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
