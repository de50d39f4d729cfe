"""SimHash near-duplicates: fingerprints, sharded vantage-point-tree similarity join, groups.

Every document is a query.  A document's fingerprint is the 64-bit SimHash of its set of words.  Two
documents are near copies when their fingerprints differ in at most `radius` bits and their numbers of
distinct words have a ratio of at least `ratio`.

Plan: equal (fingerprint, size) points collapse first, so a group of thousands of copies is one point.
The fingerprint is cut into radius + k blocks: by the pigeonhole principle a pair within `radius` agrees in k of them, so
points go to one shard for every choice of k blocks, and the shards overlap exactly where they have to.  k is the least for which an even
shard has at most SHARD points: shards get finer as the corpus grows, with the same result.  A shard that is fuller than that (many points
agree in its blocks) is parted by a hash of the point, and any two of its parts meet in a cell of their own.  In a cell, points
are parted by size band and joined by a vantage-point tree: distances to a vantage point split a set
at their median, and only the rings within `radius` of the boundary are compared across (triangle bound).
A pair counts in the first shard in which it agrees.  Pairs are not written: a cell keeps a forest of them, and a
count of each point's links, so what leaves it has a row a point however many are near each other.  The result is exact.

Cases: null texts and texts without words have no fingerprint and are linked with nothing; rows with a null id
take no part; repeated rows and ties collapse into one point, and rows of one id are one document; very long texts are read whole; extra
columns are ignored, and kept by `dedup`, which never adds a column; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import Forest, per_document
from .shared import ident, lean, parts, written
from .words import mix, pieces, words

RADIUS, RATIO, LEAF, SHARD = 9, 0.8, 512, 1 << 17


#: Byte value -> its bits, one in each byte of a 64-bit word: sums of up to 255 of them don't overflow.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def fingerprint(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each row's set of word hashes, and the size of the set."""
    low = np.uint64(40)  # bits of a word's hash that count: the same for any number of rows
    key = np.sort((row.astype(np.uint64) << low) | (h >> (np.uint64(64) - low)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    of = (key >> low).astype(np.int64)
    at = np.searchsorted(of, np.arange(rows + 1))
    size = np.diff(at)
    fp = np.zeros(rows, np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return fp, size
    byte = np.ascontiguousarray(mix(key << (np.uint64(64) - low))).view(np.uint8).reshape(-1, 8)
    # runs of at most 255 words inside a row
    runs = -(-size[full] // 255)
    begin = np.repeat(at[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    head = np.cumsum(runs) - runs
    ones = np.stack([np.add.reduceat(np.add.reduceat(_LANES[byte[:, k]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0) for k in range(8)], axis=1)
    fp[full] = np.packbits(2 * ones.reshape(-1, 64) > size[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return fp, size


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, size) of every row with an id; fp and size are null for a text without words; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w = words(b.column(1))
                fp, size = fingerprint(w.hash, w.row, w.rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32), mask=size == 0)], ["id", "fp", "size"])

    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text")).where("id is not null")
    return narrow.mapInArrow(lean(run), "id long, fp long, size int")


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that part the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _brute(fp: np.ndarray, a: np.ndarray, b: np.ndarray | None, r: int, out) -> None:
    """Calls out(i, j) with all pairs within r of a with itself (b None) or of a with b, some at a time."""
    other = a if b is None else b
    if not len(a) or not len(other):
        return
    step = max(1, (1 << 20) // len(other))
    for i in range(0, len(a), step):
        d = np.bitwise_count(fp[a[i : i + step], None] ^ fp[None, other])
        x, y = np.nonzero(d <= r)
        x += i
        if b is None:
            x, y = x[y > x], y[y > x]
        if len(x):
            out(a[x], other[y])


def vp_join(fp: np.ndarray, a: np.ndarray, b: np.ndarray | None, r: int, out, leaf: int = LEAF) -> None:
    """Self join of a (b None), or join of a and b, by vantage points; calls out(i, j) with the index pairs within r."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        if len(a) <= leaf or (b is not None and len(b) <= leaf):
            _brute(fp, a, b, r, out)
            continue
        # of a few candidates, the vantage point whose distances spread most prunes best
        tries = [np.bitwise_count(fp[a] ^ fp[a[k]]).astype(np.int16) for k in (0, len(a) // 2, len(a) - 1)]
        k = int(np.argmax([t.std() for t in tries]))
        da, mu = tries[k], np.median(tries[k])
        ins, outs = a[da <= mu], a[da > mu]
        if b is None:
            if not len(outs) or not len(ins):
                _brute(fp, a, None, r, out)
                continue
            todo += [(ins, None), (outs, None)]
            ring_in, ring_out = a[(da <= mu) & (da > mu - r)], a[(da > mu) & (da <= mu + r)]
            if len(ring_in) * len(ring_out) > 0.8 * len(a) ** 2 / 4:
                _brute(fp, ring_in, ring_out, r, out)
            else:
                todo.append((ring_in, ring_out))
        else:
            v = fp[a[(0, len(a) // 2, len(a) - 1)[k]]]
            db = np.bitwise_count(fp[b] ^ v).astype(np.int16)
            near, far = b[db <= mu + r], b[db > mu - r]
            if len(ins) * len(near) + len(outs) * len(far) > 0.8 * len(a) * len(b):
                _brute(fp, a, b, r, out)
            else:
                todo += [(ins, near), (outs, far)]


def _band(size: np.ndarray, ratio: float) -> np.ndarray:
    return np.floor(np.log(size) / -np.log(ratio)).astype(np.int64)


def cell_pairs(fp: np.ndarray, size: np.ndarray, side: np.ndarray | None, radius: int, ratio: float, out) -> None:
    """Calls out(i, j) with the index pairs that are near copies: all of a cell (side None), or those with different sides."""

    def good(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
        if ok.any():
            out(i[ok], j[ok])

    band = _band(size, ratio) if ratio > 0 else np.zeros(len(fp), np.int64)
    order = np.argsort(band, kind="stable")
    keys, at = np.unique(band[order], return_index=True)
    groups = np.split(order, at[1:])
    for n, g in enumerate(groups):
        if side is None:
            vp_join(fp, g, None, radius, good)
        else:
            vp_join(fp, g[side[g]], g[~side[g]], radius, good)
        for m in range(n + 1, min(n + 3, len(groups))):  # rounding may part equal quotients by one band more
            if keys[m] - keys[n] <= 2:
                h = groups[m]
                for a, b in [(g, h)] if side is None else [(g[side[g]], h[~side[h]]), (g[~side[g]], h[side[h]])]:
                    vp_join(fp, a, b, radius, good)


def agreeing(points: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """The number k of agreeing blocks: the least for which an even shard has at most `shard` points."""
    return next(k for k in range(1, 65 - radius) if k == 4 or points / 2 ** (64 * k / (radius + k)) <= shard)


def links(points: DataFrame, radius: int = RADIUS, ratio: float = RATIO, agree: int | None = None, shard: int = SHARD) -> DataFrame:
    """(id, root, n, fp, size): forests of the near pairs of the distinct points (id, copies, fp, size), and how many documents each is linked with."""
    k = agree or agreeing(points.count(), radius, shard)
    cut = blocks(radius + k)
    chosen = list(itertools.combinations(range(len(cut)), k))

    def value(own: tuple[int, ...]):  # the blocks of a choice, and its number, in one long
        out = F.lit(0).cast("long")
        for x in own:
            s, w = cut[x]
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")))
        return out

    spread = points.select("*", F.posexplode(F.array(*[value(own) for own in chosen])).alias("choice", "value"))
    full = spread.groupBy("choice", "value").count().where(F.col("count") > shard).select("choice", "value", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    full = written(full)  # at most one in `shard` of the spread points, and small enough to be broadcast in all but odd corpora
    own = F.pmod(F.xxhash64("fp", "size"), F.col("parts")).cast("int")
    cells = spread.join(full, ["choice", "value"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    cells = cells.select("id", "copies", "fp", "size", "choice", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") < F.col("other")).alias("side"))
    n = parts(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        ids, copies, fp, size, choice, value, low, high, side = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in range(9))
        del got
        fp = fp.view(np.uint64)
        order = np.lexsort((ids, high, low, value, choice))
        new = np.zeros(len(order), bool)
        for x in (choice, value, low, high):
            y = x[order]
            new[1:] |= y[1:] != y[:-1]
        for g in np.split(order, np.flatnonzero(new)):
            if len(g) < 2:
                continue
            own, f, forest = chosen[choice[g[0]]], fp[g], Forest(len(g))
            masks = [np.uint64(((1 << w) - 1) << s) for b, (s, w) in enumerate(cut[: own[-1]]) if b not in own]

            def out(i: np.ndarray, j: np.ndarray) -> None:
                x, first = f[i] ^ f[j], np.ones(len(i), bool)  # noqa: B023
                for mask in masks:  # noqa: B023
                    first &= x & mask != 0  # else an earlier choice has the pair
                if first.any():
                    forest.add(i[first], j[first], copies[g])  # noqa: B023

            cell_pairs(f, size[g], None if low[g[0]] == high[g[0]] else side[g], radius, ratio, out)
            if forest.met.any():
                yield forest.rows(ids[g], fp=f.view(np.int64), size=size[g])

    return cells.repartition(n, "choice", "value", "low", "high").mapInArrow(lean(run), "id long, root long, n long, fp long, size int")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, ratio: float = RATIO, agree: int | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row with an id: the least id of its group of near copies, and the number of its near copies."""
    fps = written(fingerprints(docs, id_col, text_col))
    points = written(fps.where("fp is not null").groupBy("fp", "size").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "fp", "size"))
    return per_document(fps, points, links(points, radius, ratio, agree, shard), ["fp", "size"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """docs with one document of each group: the one with the least id.

    Of rows that repeat an id, one stays (the least text).  Rows without an id, and texts without words, are kept.
    """
    found = written(near_classes(docs, id_col, text_col, radius, ratio))
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns may have any name
    id_, text = (safe[f"c{docs.columns.index(c)}"] for c in (id_col, text_col))
    drop = found.where("doc_id <> class_id").select(F.col("doc_id").alias("drop_id")).distinct()
    twice = written(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id")))
    kept = safe.join(drop, id_.cast("long") == F.col("drop_id"), "left_anti")
    if not twice.isEmpty():
        # of rows with one id, the one with the least text (nulls first), then the least JSON of the row
        many = kept.join(twice, id_.cast("long") == F.col("twice_id"), "left_semi")
        w = Window.partitionBy(id_.cast("long")).orderBy(text, F.to_json(F.struct(*safe.columns)))
        rest = many.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
        kept = kept.join(twice, id_.cast("long") == F.col("twice_id"), "left_anti").unionByName(rest)
    return kept.toDF(*docs.columns)
