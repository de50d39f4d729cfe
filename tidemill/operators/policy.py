"""Failure policy of a loader: budgets, bounded skipping, summaries; flow control; rates and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budgets:
    """Failures that are borne: in a row (the run that reaches it raises), in an epoch, and in all; None is no limit."""

    consecutive: int | None = 3
    epoch: int | None = 10
    total: int | None = None


def counted(df: DataFrame, part: Sequence[str], pos: str, ok: Column, epoch: str | None = None) -> DataFrame:
    """df with `consecutive`, `in_epoch` and `in_total`: the failures up to each row, in a row, in its epoch and in all of its part.

    A success resets the first, a new epoch the first two.
    """
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [*part, epoch] if epoch else list(part)
    e = Window.partitionBy(*own).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.when(ok, 0).otherwise(1)
    got = df.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(F.col("_bad") == 0, 1).otherwise(0)).over(e))
    r = Window.partitionBy(*own, "_run").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return got.withColumn("consecutive", F.sum("_bad").over(r)).withColumn("in_epoch", F.sum("_bad").over(e)).withColumn("in_total", F.sum("_bad").over(w)).drop("_bad", "_run")


def stops(df: DataFrame, part: Sequence[str], pos: str, ok: Column, budgets: Budgets = Budgets(), epoch: str | None = None) -> DataFrame:
    """(part, stop, why): where a budget is first exceeded, and which: the row that raises.  Parts that never raise have no row."""
    c = counted(df, part, pos, ok, epoch)
    why = F.lit(None).cast("string")
    for name, limit, over in (("total", budgets.total, F.col("in_total") > budgets.total), ("epoch", budgets.epoch, F.col("in_epoch") > budgets.epoch), ("consecutive", budgets.consecutive, F.col("consecutive") >= budgets.consecutive)):
        if limit is not None:
            why = F.when(over, name).otherwise(why)
    at = F.col("consecutive") > 0  # only a failure raises
    return c.withColumn("why", F.when(at, why)).where("why is not null").groupBy(*part).agg(F.min(pos).alias("stop"), F.min_by("why", pos).alias("why"))


def skipped_to(df: DataFrame, part: Sequence[str], pos: str, ok: Column, attempts: int = 100) -> DataFrame:
    """df with next_pos, the first valid position from here on, round the end of the part, and tries, how many rows were looked at.

    At most min(attempts, rows of the part) rows are tried: beyond that, and where no row is valid, next_pos is null and `tries` is that limit.
    """
    w = Window.partitionBy(*part).orderBy(pos)
    every = Window.partitionBy(*part)
    here = F.when(ok, F.struct(F.col(pos).alias("pos"), F.col("_i").alias("i")))
    ahead = F.min(here).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    got = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(every))
    got = got.withColumn("_next", F.coalesce(ahead, F.min(here).over(every)))
    far = F.pmod(F.col("_next.i") - F.col("_i"), F.col("_n")) + 1
    limit = F.least(F.lit(attempts), F.col("_n"))
    found = F.coalesce(far <= limit, F.lit(False))
    return got.withColumn("next_pos", F.when(found, F.col("_next.pos"))).withColumn("tries", F.when(found, far).otherwise(limit).cast("long")).drop("_i", "_n", "_next")


def summary(df: DataFrame, kind: Column, pos: str, last: int = 5) -> DataFrame:
    """(kind, n, rate, last): failures by kind (null: none), their share of all rows, and the positions of the last few, newest first."""
    g = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("_all").alias("_all")) if "_all" in df.columns else None
    if g is None:
        total = df.agg(F.count("*").alias("_all"))
        g = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    bad = df.select(kind.alias("kind"), F.col(pos).alias("p")).where("kind is not null")
    # each task keeps its own few before they meet
    few = bad.withColumn("_task", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy("kind", "_task").orderBy(F.desc("p")))).where(F.col("_r") <= last)
    few = few.groupBy("kind").agg(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, last).alias("last"))
    return g.where("kind is not null").withColumn("rate", F.col("n") / F.col("_all")).drop("_all").join(few, "kind")


def blocked(df: DataFrame, part: Sequence[str], pos: str, level: Column, low: Column, high: Column) -> DataFrame:
    """df with `blocked`: whether producers wait after each row: from when the level reaches `high` until it falls to `low` (hysteresis).

    A fold without a loop: the last row at which the level was at one of the marks says which.
    """
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(level >= high, True).when(level <= low, False)
    return df.withColumn("blocked", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def refresh_due(step: Column, every: int | None) -> Column:
    """Whether a refresh is due after a step, counted from 0: after every `every`-th; None: only at the end of an epoch."""
    return F.lit(False) if every is None else F.pmod(step + 1, F.lit(every)) == 0


def stale(waited: Column, unadmitted: Column, seconds: float = 120.0, episodes: int = 10) -> Column:
    """Whether a listing has been out of date for so long, and by so much, that a warning is due."""
    return (waited >= seconds) & (unadmitted >= episodes)


@dataclass
class TokenBucket:
    """At most `rate` calls a second in the long run, `burst` at once; for the driver's own requests."""

    rate: float = 2.5
    burst: float = 10.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    tokens: float = field(init=False)
    last: float = field(init=False)

    def __post_init__(self) -> None:
        if self.rate <= 0 or self.burst < 1:
            raise ValueError("a bucket needs a rate above 0, and a burst of at least 1")
        self.tokens, self.last = self.burst, self.clock()

    def acquire(self) -> float:
        """Takes a token, waiting for it if there is none; returns the seconds waited."""
        now = self.clock()
        self.tokens, self.last = min(self.burst, self.tokens + (now - self.last) * self.rate), now
        wait = max(0.0, (1 - self.tokens) / self.rate)
        if wait:
            self.sleep(wait)
            now = self.clock()
            self.tokens, self.last = min(self.burst, self.tokens + (now - self.last) * self.rate), now
        self.tokens -= 1
        return wait


def retried(call: Callable, bucket: TokenBucket, limited: Callable[[Exception], bool], attempts: int = 4, first_wait: float = 30.0):
    """call(), again after first_wait * 2 ** n seconds while it fails for its rate; other failures, and the last one, are raised."""
    for n in range(attempts):
        bucket.acquire()
        try:
            return call()
        except Exception as e:
            if not limited(e) or n == attempts - 1:
                raise
            bucket.sleep(first_wait * 2**n)
    raise ValueError("no attempts")
