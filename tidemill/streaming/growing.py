"""Growing directories as streams: admission, freeze and pin, ring state, failure policy, loader state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a directory as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, once, batch by batch; a later call goes on from there."""
    df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def admit(admitted: DataFrame, seen: DataFrame, key: str, train: Callable | None = None, min_new: int = 0) -> DataFrame:
    """The admitted keys after a refresh: new keys of the train split join; fewer than min_new change nothing; an empty update never wipes."""
    fresh = seen.select(key).distinct()
    if train is not None:
        fresh = fresh.where(train(F.col(key)))
    fresh = fresh.join(admitted.select(key), key, "left_anti")
    if min_new and fresh.limit(min_new).count() < min_new:
        return admitted.select(key)
    return admitted.select(key).unionByName(fresh)


def ring(df: DataFrame, group: str, key: str, order: str, capacity: int) -> DataFrame:
    """(group, key, evicted): each put into a ring of `capacity` slots kept for each group, with the key that it pushed out."""

    class Ring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.slots = handle.getListState("slots", StructType([StructField("key", LongType())]))

        def handleInputRows(self, g, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = [r[0] for r in self.slots.get()] if self.slots.exists() else []
            out = []
            for k in pd.concat(list(rows)).sort_values(order)[key]:
                out.append((g[0], int(k), held.pop(0) if len(held) >= capacity else None))
                held.append(int(k))
            self.slots.put([(k,) for k in held])
            yield pd.DataFrame(out, columns=["group", "key", "evicted"]).astype({"group": "int64", "key": "int64", "evicted": "Int64"})

        def close(self) -> None:
            pass

    return df.groupBy(group).transformWithStateInPandas(Ring(), "group long, key long, evicted long", "append", "none")


def failure_abort(df: DataFrame, order: str, ok: str, most: int) -> bool:
    """Whether some run of failures is longer than the policy bears; a success resets it."""
    from ..operators.order import by_number

    # a failure's place in the log less its place among failures is the same along a run
    placed = by_number(df.select(order, ok), order, name="_pos").where(~F.col(ok))
    among = by_number(placed, order, name="_bad")
    return bool(among.groupBy(F.col("_pos") - F.col("_bad")).count().where(F.col("count") > most).limit(1).count())


@dataclass
class LoaderState:
    """Where a loader stands: a small JSON document; the order itself is a function of seed and epoch."""

    seed: int = 42
    epoch: int = 0
    batches_done: int = 0
    pinned: list[str] = field(default_factory=list)

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> LoaderState:
        return cls(**json.loads(text))
