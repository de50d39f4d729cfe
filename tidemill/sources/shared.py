"""The folder that all executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, one of its own in local mode (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: compact, and safe from the loss of executors."""
    path = work_dir(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
