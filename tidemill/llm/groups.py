"""Groups of linked documents: union-find inside a task, connected components across tasks, one row for each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, written

class Forest:
    """Numbers 0 .. n - 1 in order of their ids, joined by pairs; and for each the number of documents that it is linked with."""

    def __init__(self, n: int):
        self.parent, self.links, self.met = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)

    def _root(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[i] = r
        return r

    def add(self, i: np.ndarray, j: np.ndarray, copies: np.ndarray) -> None:
        """Join i with j, pair by pair; each pair comes once.  copies: the documents that a number stands for."""
        n = len(self.parent)
        self.links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
        self.met[i] = self.met[j] = True
        while len(i):
            a, b = self._root(i), self._root(j)
            on = a != b
            i, j, a, b = i[on], j[on], a[on], b[on]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def rows(self, ids: np.ndarray, **key: np.ndarray) -> pa.RecordBatch:
        """(id, root, n, key) of the numbers that are in a pair."""
        at = np.flatnonzero(self.met)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], ids[self._root(at)], self.links[at], *(k[at] for k in key.values()))], ["id", "root", "n", *key])


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): connected components of edges (a, b); root is the least id.  Only ids with an edge appear.

    Each round hooks every vertex to the least root among its neighbours and then jumps to the root's root;
    rounds are checkpointed in the shared folder and end when nothing changes, so chains of any length come out right.
    """
    edges = checkpoint(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    roots = checkpoint(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        low = edges.join(roots.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        hook = roots.join(low, roots.id == low.a).select("id", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        # the old root learns of the better one too, so far parts of a chain merge at once
        up = hook.groupBy("old").agg(F.min("root").alias("best"))
        jump = hook.join(up, "old").select("id", "old", F.least("root", "best").alias("root"))
        over = roots.select(F.col("id").alias("r"), F.col("root").alias("rr"))
        new = checkpoint(jump.join(over, jump.root == over.r, "left").select("id", "old", F.least("root", F.coalesce("rr", "root")).alias("root")))
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("id", "root")
        if not changed:
            return roots


def per_document(rows: DataFrame, points: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.

    rows: (id, key), with a null key for what is linked with nothing; points: (id, copies, key), the rows of each key counted, by their least id;
    found: (id, root, n, key), the forests of links between points.  Rows of one id are one document, and join its points.  class_id: the least doc_id of all
    that are linked, directly or not; n_links: the number of other rows with the same key or a linked one.  A key may hold any share of all rows.
    """
    found = written(found)
    twice = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    of_id = rows.join(twice, "id", "left_semi").join(points.select(*key, F.col("id").alias("b")), key).select(F.col("id").alias("a"), "b")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(of_id))
    links = found.groupBy(*key).agg(F.sum("n").alias("n"))
    point = points.join(links, key, "left").join(roots, "id", "left")
    point = point.select(*key, F.coalesce("root", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    bare = F.col(key[0]).isNull()
    linked = rows.where(~bare).join(point, key).select(F.col("id").alias("doc_id"), "class_id", "n_links")
    # what has no key stands alone, unless its id has another row
    alone = rows.where(bare).join(roots, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)
