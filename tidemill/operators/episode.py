"""Episodes: frames in order, delta windows with clamp and padding flags, readiness, namespaced lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(events: DataFrame, episode: str, *order: str) -> DataFrame:
    """events with their frame number and the episode's length."""
    w = Window.partitionBy(episode)
    return events.withColumn("frame", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def delta_indices(deltas: Sequence[float], fps: float) -> list[int]:
    """Frame offsets of times, rounded half to even."""
    return [round(x * fps) for x in deltas]


def delta_window(rows: DataFrame, episode: str, value: str, deltas: Sequence[int]) -> DataFrame:
    """rows (with frame and n) with the values at frame + delta, clamped to the episode, and whether each was clamped.

    Few constant deltas are lag and lead over one sort of the episode; no array of an episode is built.
    """
    w = Window.partitionBy(episode).orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(d: int) -> Column:
        end = F.first(value).over(whole) if d < 0 else F.last(value).over(whole)
        inside = F.lag(value, -d).over(w) if d < 0 else F.lead(value, d).over(w) if d else F.col(value)
        here = (F.col("frame") + d >= 0) & (F.col("frame") + d < F.col("n"))
        return F.when(here, inside).otherwise(end)

    flags = F.array(*[(F.col("frame") + d < 0) | (F.col("frame") + d >= F.col("n")) for d in deltas])
    return rows.withColumn(f"{value}_window", F.array(*[at(d) for d in deltas])).withColumn(f"{value}_is_pad", flags)


def lookup(rows: DataFrame, table: DataFrame, on: str, value: str, default: str = "") -> DataFrame:
    """rows with the value of a small table, or the default."""
    return rows.join(table, on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def timestamp_faults(rows: DataFrame, episode: str, seconds: Column, fps: float, tolerance: float) -> DataFrame:
    """Frames whose distance from the one before in their episode isn't 1 / fps."""
    w = Window.partitionBy(episode).orderBy("frame")
    gap = rows.withColumn("gap", seconds - F.lag(seconds).over(w))
    return gap.where(F.abs(F.col("gap") - 1 / fps) > tolerance)


def episode_path(ep: Column, chunk: int = 1000) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(ep / chunk), ep)
