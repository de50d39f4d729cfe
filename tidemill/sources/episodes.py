"""Metadata of episode directories: info.json, tasks.jsonl, episodes.jsonl; readiness by files; positional numbers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MissingData

EPISODES = "episode_index long, length long, tasks array<string>"
TASKS = "task_index long, task string"


def _file(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def info(spark: SparkSession, root: str) -> dict:
    """meta/info.json; without it there is no data set."""
    path, fs = _file(spark, f"{root}/meta/info.json")
    if not fs.exists(path):
        raise MissingData(f"{root}/meta/info.json")
    return json.loads("\n".join(r.value for r in spark.read.text(str(path)).collect()))  # one small document


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """(task_index, task) of meta/tasks.jsonl; empty if there is no such file."""
    path, fs = _file(spark, f"{root}/meta/tasks.jsonl")
    return spark.read.schema(TASKS).json(str(path)) if fs.exists(path) else spark.createDataFrame([], TASKS)


def episodes(spark: SparkSession, root: str) -> DataFrame:
    """(episode_index, length, tasks) of meta/episodes.jsonl; without it there are no lengths, which is an error."""
    path, fs = _file(spark, f"{root}/meta/episodes.jsonl")
    if not fs.exists(path):
        raise MissingData(f"{root}/meta/episodes.jsonl")
    return spark.read.schema(EPISODES).json(str(path))


def files(spark: SparkSession, root: str, pattern: str = "data/*/episode_*.parquet") -> DataFrame:
    """(episode_index, path, bytes) of the episode files that are there; only their names and sizes are read."""
    found = spark.read.format("binaryFile").load(f"{root}/{pattern}").select("path", F.col("length").alias("bytes"))
    return found.select(F.regexp_extract("path", r"episode_(\d+)", 1).cast("long").alias("episode_index"), "path", "bytes")


def ready(listing: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """(episode_index) of the episodes whose data file is there, and one file of every media key: media has (episode_index, key)."""
    data = listing.select("episode_index").distinct()
    if not keys:
        return data
    full = media.where(F.col("key").isin(*keys)).groupBy("episode_index").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(keys))
    return data.join(full.select("episode_index"), "episode_index", "left_semi")


def positional(df: DataFrame, raw: str, name: str = "position") -> DataFrame:
    """(raw, position): the episodes that are there numbered without gaps, in the order of their raw numbers."""
    from ..operators.order import by_number

    return by_number(df.select(raw).distinct(), raw, name=name)


def contiguous(df: DataFrame, position: str, length: str) -> DataFrame:
    """df with [first, past): the rows of each episode in the whole table."""
    from ..operators.order import offsets_of

    return offsets_of(df, position, length).withColumn("past", F.col("off") + F.col(length)).withColumnRenamed("off", "first")


def check_rows(ranges: DataFrame, rows: int) -> None:
    """Raises if the episodes don't add up to the table."""
    past = ranges.agg(F.max("past")).first()[0] or 0
    if past != rows:
        raise ValueError(f"episodes end at row {past}, the table has {rows}")
