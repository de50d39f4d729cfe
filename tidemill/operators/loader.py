"""A loader in one call: seeded order, share of a rank, batches, resumption; row transforms; splits; kernels."""

from __future__ import annotations

import math
import os
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ..streaming.growing import LoaderState
from . import order


def workers(n: int, cores: int | None = None) -> int:
    """A number of tasks at once: -1 is an eighth of the cores, rounded up to an even number, 2 at least."""
    if n >= 0:
        return n
    if n != -1:
        raise ValueError("workers are -1 or more")
    eighth = math.ceil((cores or os.cpu_count() or 4) / 8)
    return max(2, eighth + eighth % 2)


def loader(df: DataFrame, ident: str, batch_size: int, seed: int = 42, epoch: int = 0, rank: int = 0, world: int = 1, shuffle: bool = True, drop_last: bool = False, state: LoaderState | None = None) -> DataFrame:
    """The rows that are left for one rank in an epoch, with pos, step (within the rank) and batch_id; `state` says what has been done already."""
    if batch_size < 1 or not 0 <= rank < world:
        raise ValueError("a batch has a row at least, and a rank is below the world's size")
    if state is not None:
        seed, epoch = state.seed, state.epoch
    placed = order.permutation(df, ident, seed, epoch) if shuffle else order.by_number(df, ident)
    total = df.count()
    own = order.rank_rows(placed, world, total, drop_last).where(F.col("rank") == rank)
    share = total // world if drop_last else -(-total // world)
    out = order.batches(own, batch_size, share if drop_last else None, "step")
    return out if state is None else out.where(F.col("batch_id") >= state.batches_done)


def composed(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transform of several, in order."""
    if not steps:
        raise ValueError("nothing to compose")

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def row_transform(df: DataFrame, column: str, value: Column) -> DataFrame:
    """df with a column's value replaced; rows for which it is null are dropped, as a transform that returns nothing does."""
    return df.withColumn(column, value).where(F.col(f"`{column}`").isNotNull())


def split_rule(train: float) -> tuple[int, int]:
    """(bucket, first): keys with key % bucket < first are of the train split.  Buckets are of 10, 5, 4 or 2; others get 10, 9, with a warning."""
    if not 0 < train < 1:
        raise ValueError("a share of the train split lies between 0 and 1")
    for bucket in (10, 5, 4, 2):
        held = round(bucket * (1 - train))
        if held >= 1 and abs(held / bucket - (1 - train)) < 1e-3:
            return bucket, bucket - held
    warnings.warn(f"{train} is no share of a bucket; 0.9 is taken", stacklevel=2)
    return 10, 9


def in_train(key: Column, train: float) -> Column:
    bucket, first = split_rule(train)
    return F.pmod(key, F.lit(bucket)) < first


def kernel_tokens(docs: DataFrame, text_col: str, kernel: Callable[[str], tuple[Sequence[int], Sequence[bool]] | None], most_failures: int = 500) -> DataFrame:
    """docs without the text, with (tokens, mask) from a function of one's own; blank texts, and those it returns nothing or an empty list for, are left out.

    A text that it fails on is left out too; `most_failures` of them in a row in a task fail the job.  The first text of a task is tried before others.
    """
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            keep, tokens, masks = [], [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                if text is None or not text.strip():
                    continue
                try:
                    got = kernel(text)
                    if got is not None and len(got[0]) != len(got[1]):
                        raise ValueError("mask and tokens differ in length")
                    row = 0
                except Exception as e:
                    row += 1
                    if row >= most_failures:
                        raise RuntimeError(f"the kernel failed on {row} texts in a row") from e
                    continue
                if got is not None and len(got[0]):
                    keep.append(i), tokens.append(list(got[0])), masks.append(list(got[1]))
            own = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(own.columns) if k != at), pa.array(tokens, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], [*(f.name for f in rest), "tokens", "mask"])

    return docs.mapInArrow(run, StructType([*rest, StructField("tokens", ArrayType(IntegerType())), StructField("mask", ArrayType(BooleanType()))]))
