"""Shard directories: scan, catalogue, addresses, retention, eviction, companions; shard writers; cache keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class MissingData(FileNotFoundError):
    """A split or directory that isn't there, or holds no shard."""


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, skip_corrupt: bool = True) -> DataFrame:
    """A directory of Parquet shards; unreadable files are skipped; a missing or empty one is an error."""
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt)
    try:
        df = reader.parquet(path)
    except Exception as e:
        # by version of the JVM side; the first may mean that just the file that was asked for the schema is unreadable
        if "UNABLE_TO_INFER_SCHEMA" in str(e) and (schema := _schema(spark, path)) is not None:
            df = reader.schema(schema).parquet(path)
        elif "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise MissingData(path) from e
        else:
            raise
    return df.select(*columns) if columns else df


def _schema(spark: SparkSession, path: str):
    """The schema of the first readable Parquet file of a directory, by name; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
    for file in files:
        if file.endswith(".parquet"):
            try:
                return spark.read.parquet(file).schema
            except Exception as e:
                if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e) and "not a Parquet file" not in str(e):
                    raise
    return None


def token_scan(spark: SparkSession, path: str, split: str) -> DataFrame:
    """input_ids as longs, and labels equal to them, of a split."""
    ids = F.col("input_ids").cast("array<bigint>")
    return scan(spark, f"{path}/{split}").select(ids.alias("input_ids"), ids.alias("labels"))


def catalog(df: DataFrame) -> DataFrame:
    """(file, bytes, rows, off) of the files of a scan, in the order of their names; off: rows before."""
    shards = df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return offsets(shards, "file", "rows")


def offsets(shards: DataFrame, name: str, rows: str) -> DataFrame:
    """shards (one row each: a small table) with the rows before each."""
    before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("off", F.coalesce(F.sum(rows).over(before), F.lit(0)))


def locate(positions: DataFrame, shards: DataFrame, pos: str = "pos") -> DataFrame:
    """positions with the shard that holds each and the row inside it; positions past the end wrap round.

    Files' ranges are cut at multiples of their mean length, so a position finds its file by an equal join on a bin: there are at most two bins a file.
    """
    total, many = shards.agg(F.sum("rows"), F.count("*")).first()
    width = max(1, -(-(total or 1) // max(many, 1)))
    bins = F.sequence(F.floor(F.col("off") / width), F.floor((F.col("off") + F.col("rows") - 1) / width))
    right = shards.where("rows > 0").withColumn("_bin", F.explode(bins))
    at = positions.withColumn("_at", F.pmod(pos, F.lit(total or 1))).withColumn("_bin", F.floor(F.col("_at") / width))
    got = at.join(right, "_bin").where((F.col("_at") >= F.col("off")) & (F.col("_at") < F.col("off") + F.col("rows")))
    return got.withColumn("local", F.col("_at") - F.col("off")).drop("_at", "_bin")


def retained(shards: DataFrame, name: str, size: str, budget: int) -> DataFrame:
    """Of the shards in the order of their names, the newest whose sizes fit the budget."""
    newest = Window.orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    return shards.withColumn("kept_bytes", F.sum(size).over(newest)).where(F.col("kept_bytes") <= budget)


def evictable(shards: DataFrame, name: str, strategy: str, digest: Column | None = None) -> DataFrame:
    """The shard that goes next: 'fifo' the first name, 'random' by digest, 'stochastic_oldest' by digest from the older half."""
    if strategy not in ("fifo", "random", "stochastic_oldest"):
        raise ValueError(f"unknown strategy {strategy}")
    n = F.count("*").over(Window.partitionBy())
    ranked = shards.withColumn("rn", F.row_number().over(Window.orderBy(name))).withColumn("n", n)
    if strategy == "fifo":
        return ranked.where("rn = 1").drop("rn", "n")
    pool = ranked.where("rn <= greatest(1, n div 2)") if strategy == "stochastic_oldest" else ranked
    return pool.withColumn("_d", digest).orderBy("_d").limit(1).drop("_d", "rn", "n")


def write_shards(df: DataFrame, path: str, text_col: str = "text", rows: int = 10_000) -> None:
    """Text that isn't blank as zstd Parquet of at most `rows` rows a file; Spark's commit makes it appear at once."""
    df.where(F.col(text_col).rlike("\\S")).write.option("maxRecordsPerFile", rows).option("compression", "zstd").mode("append").parquet(path)


def cache_key(name: str, length: int, spec: dict, version: int = 1) -> str:
    """The directory name of a cached table: any change of spec or length makes another."""
    text = json.dumps({"name": name, "length": length, "spec": spec}, sort_keys=True, separators=(",", ":"))
    return f"{name}_v{version}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def cached(df: DataFrame, root: str, name: str, spec: dict) -> DataFrame:
    """df from the directory of its cache key, written there first if it isn't."""
    spark = df.sparkSession
    path = f"{root}/{cache_key(name, df.count(), spec)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def token_rows(tokens: DataFrame, wanted: list[int], pos: str = "pos") -> DataFrame:
    """The rows of a numbered token scan at given positions; a position outside it is an error."""
    n = tokens.count()
    bad = [w for w in wanted if not 0 <= w < n]
    if bad:
        raise IndexError(f"row {bad[0]} of {n}")
    return tokens.where(F.col(pos).isin(wanted))
