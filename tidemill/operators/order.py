"""Total orders at scale: global row numbers without a single-task window, permutations, ranks, batches, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key

BUCKETS = 4096  #: pieces of an order that are numbered apart; their counts are all that one task or the driver sees


def numbered(df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """df with its 0-based position in (bucket, *order); the bucket must not contradict the order, and has at most BUCKETS values."""
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))  # at most BUCKETS rows
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return with_bucket.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + inside - 1).drop("_bucket", "_offset")


def numbered_in(df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """df with its 0-based position inside its part, in (bucket, *order), so that a part with most rows is no single task's; see `numbered`."""
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy(*part, "_bucket").count()
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(*order))
    return with_bucket.withColumn("_n", inside).join(offsets, [*part, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_n") - 1).drop("_bucket", "_offset", "_n")


def by_digest(df: DataFrame, digest: Column, *ties: Column, name: str = "pos") -> DataFrame:
    """Positions in the order of a hex digest; its first three digits are the buckets."""
    return numbered(df.withColumn("_digest", digest), F.substring("_digest", 1, 3), [F.col("_digest"), *ties], name).drop("_digest")


def by_number(df: DataFrame, column: str, *ties: Column, name: str = "pos") -> DataFrame:
    """Positions in the order of an integer column; the buckets are equal ranges of its values, but for the outermost ones, which take what is far off."""
    ends = df.agg(F.percentile_approx(column, [0.0005, 0.9995], 10_000)).first()[0]
    if ends is None:
        return df.withColumn(name, F.lit(None).cast("long")).where("false")
    low, high = ends
    width = max(1, -(-(high - low + 1) // (BUCKETS - 2)))
    bucket = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) + 1
    return numbered(df, F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), bucket)), [F.col(column), *ties], name)


def permutation(df: DataFrame, ident: str, seed: int = 42, epoch: int = 0, name: str = "pos") -> DataFrame:
    """A seeded shuffle of df for an epoch."""
    return by_digest(df, key(seed, epoch, F.col(ident)), F.col(ident), name=name)


def rank_rows(df: DataFrame, world: int, total: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """df with (rank, step): the strided share of each rank; short shares repeat the prefix, or with drop_last all are cut to equal length."""
    if drop_last:
        out = df.where(F.col(pos) < total // world * world)
    else:
        missing = -total % world
        # the prefix may have to be repeated more than once if there are fewer rows than ranks
        again = [df.where(F.col(pos) < missing - k * total).withColumn(pos, F.col(pos) + (k + 1) * total) for k in range(-(-missing // total) if total else 0)]
        out = df
        for extra in again:
            out = out.unionByName(extra)
    return out.withColumn("rank", F.pmod(pos, F.lit(world)).cast("int")).withColumn("step", F.floor(F.col(pos) / world))


def batches(df: DataFrame, size: int, total: int | None = None, pos: str = "pos") -> DataFrame:
    """df with its batch_id; given the total, an incomplete last batch is dropped."""
    out = df if total is None else df.where(F.col(pos) < total // size * size)
    return out.withColumn("batch_id", F.floor(F.col(pos) / size))


def resume(df: DataFrame, batches_done: int, size: int, total: int | None = None, pos: str = "pos") -> DataFrame:
    """What is left of the order after some batches; past the end of an epoch it goes on in the next round of the same order."""
    cursor = batches_done * size
    if total:
        return df.withColumn("logical_epoch", F.lit(cursor // total)).where(F.col(pos) >= cursor % total)
    return df.where(F.col(pos) >= cursor)


def pooled(df: DataFrame, shard: str, row: str, pool: int = 3, seed: int = 42, epoch: int = 0) -> DataFrame:
    """df in the order of a reader that keeps `pool` shards open and draws rows from all of them: with `pool_id`, and `pos` in the whole order.

    Shards go in seeded order, `pool` at a time; the rows of a pool are mixed.  Every row comes once.
    """
    shards = permutation(df.select(shard).distinct(), shard, seed, epoch, "_rank").withColumn("pool_id", F.floor(F.col("_rank") / pool)).drop("_rank")
    placed = df.join(shards, shard).withColumn("_digest", key(seed, epoch, F.col(shard), F.col(row)))
    # buckets: a pool's rows by three digits of their digest; rows before a bucket are prefix sums of counts
    placed = placed.withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = placed.groupBy("pool_id", "_bucket").count()
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("pool_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = offsets_of(counts.groupBy("pool_id").agg(F.sum("count").alias("count")), "pool_id", "count")
    starts = counts.withColumn("_in", inside).join(totals, "pool_id").select("pool_id", "_bucket", (F.col("_in") + F.col("off")).alias("_off"))
    w = Window.partitionBy("pool_id", "_bucket").orderBy("_digest", shard, row)
    return placed.withColumn("_n", F.row_number().over(w)).join(starts, ["pool_id", "_bucket"]).withColumn("pos", F.col("_off") + F.col("_n") - 1).drop("_digest", "_bucket", "_n", "_off")


def offsets_of(df: DataFrame, key_col: str, count: str) -> DataFrame:
    """df (a row for each piece of an order) with the counts before each, in two phases, so that no task sees all pieces."""
    low, high = df.agg(F.min(key_col), F.max(key_col)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    part = df.withColumn("_b", F.floor((F.col(key_col) - F.lit(low or 0)) / F.lit(width)))
    sums = part.groupBy("_b").agg(F.sum(count).alias("_s"))
    outer = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # at most BUCKETS rows
    own = F.coalesce(F.sum(count).over(Window.partitionBy("_b").orderBy(key_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("_i", own).join(F.broadcast(outer), "_b").withColumn("off", F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def buffered(df: DataFrame, size: int, seed: int = 42, epoch: int = 0, ident: str = "pos") -> DataFrame:
    """df (with pos) as a shuffle buffer of `size` rows mixes a stream: `out`, the new position, less than `size` from pos.

    Every row comes once; the last rows are mixed among themselves, as a draining buffer does.
    """
    w = Window.partitionBy("_block").orderBy(key(seed, epoch, F.col(ident)), ident)
    placed = df.withColumn("_block", F.floor(F.col("pos") / size))
    return placed.withColumn("out", F.col("_block") * size + F.row_number().over(w) - 1).drop("_block")
