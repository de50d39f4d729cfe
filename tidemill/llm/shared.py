"""What several operators need: the shared folder, tables, columns by name, and workers that give memory back."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["checkpoint", "ident", "lean", "map_rows", "parts", "release", "shared_dir", "table", "written"]


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept reliably in the shared folder; its lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives this process's free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, after which the Python worker gives its free memory back: workers are kept for later stages, which need it."""

    def then(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return then


def ident(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run) -> DataFrame:
    """df with its batches mapped by run to batches of the same columns; names with dots, or twice, do no harm."""
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return safe.mapInArrow(lean(run), safe.schema).toDF(*df.columns)
