"""Replayable randomness: md5 of a key, the same on every engine and cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, epoch: int | Column, *parts: Column) -> Column:
    """Hex digest of seed, epoch and key columns; sorting by it is a permutation for each (seed, epoch)."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), e.cast("string"), *[p.cast("string") for p in parts]))


def uniform(digest: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
