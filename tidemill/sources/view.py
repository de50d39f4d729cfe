"""What a reader sees of a growing directory: freeze, pin, unfreeze, deferred eviction, swapped lists."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refreshed(admitted: DataFrame, listing: DataFrame, scheduled: DataFrame, key: str, frozen: bool = False, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(visible, removed) after a refresh: tables of keys.

    New shards are always admitted.  Shards scheduled for eviction go, unless the view is frozen: then they stay till a later refresh.
    A pinned view shows only the shards of its pins that are there.
    """
    seen = admitted.select(key).union(listing.select(key)).distinct()
    removed = seen.join(scheduled.select(key).distinct(), key, "left_semi")
    if frozen:
        removed = removed.where("false")
    visible = seen.join(removed, key, "left_anti")
    if pinned is not None:
        visible = visible.join(pinned.select(key).distinct(), key, "left_semi")
    return visible, removed


def missing_pins(pinned: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Pins that aren't there any more: a restored state can't be read whole."""
    return pinned.select(key).distinct().join(listing.select(key), key, "left_anti")


def swapped(batches: DataFrame, lists: DataFrame, batch: str, source: str, member: str) -> DataFrame:
    """Each batch with the members of its source's list as it is when the batch begins.

    lists: (source, member, since): from which batch on a list holds; the latest that began counts, as a whole.  Sources without a list have no rows.
    """
    starts = lists.select(source, "since").distinct()
    own = batches.join(starts, source).where(F.col("since") <= F.col(batch)).groupBy(batch, source).agg(F.max("since").alias("since"))
    return own.join(lists, [source, "since"]).select(batch, source, member)


@dataclass
class ViewState:
    """What has to be kept to go on with the same view: a small JSON document."""

    pinned: list[str] | None = None
    frozen: bool = False
    scheduled: list[str] = field(default_factory=list)

    def freeze(self, pins: list[str] | None = None) -> None:
        self.frozen, self.pinned = True, pins

    def unfreeze(self) -> None:
        self.frozen, self.pinned = False, None

    def schedule(self, *names: str) -> None:
        self.scheduled = list(dict.fromkeys([*self.scheduled, *names]))

    def take_scheduled(self) -> list[str]:
        """The shards to remove now: none while frozen."""
        if self.frozen:
            return []
        out, self.scheduled = self.scheduled, []
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> ViewState:
        return cls(**json.loads(text))
