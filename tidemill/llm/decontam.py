"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (lower case; every run of other bytes than letters and digits is one space).  A document leaks
an item if some window of WINDOW bytes of the item (the whole item, if shorter) aligns with a part of the document with at
most `edits` of its length in edits.  A window of n bytes with e edits keeps at least t = n + 1 - q (e + 1) of its q-grams,
all within e diagonals of each other.  So: look up every q-gram of every whole document in the benchmark's q-gram index,
put the hits into overlapping diagonal bands, keep windows with at least t distinct q-grams in a band, and verify them by
banded alignment.  No window that meets the edit budget is lost.

The index is made and broadcast in chunks of at most INDEX_BYTES of benchmark text, one after another, at about 21 bytes of index a
byte of text (a longer single item is a chunk of its own); a larger benchmark takes several scans.

Cases: a null or empty text, or an item of less than q bytes, never matches; a null item id is no item; where
the budget leaves less than one q-gram, it is lowered until one is left; a null document id is kept, and very long texts are read whole; repeated
rows each have their leaks, and repeated items give repeated (doc, item) rows; of windows that tie, the region covers all; extra
columns are ignored by `leaks` and kept by `clean`; empty tables give no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ident, lean, map_rows
from .words import WORD_BYTE, grams, pieces, raw

Q, WINDOW, EDITS, INDEX_BYTES = 12, 64, 0.05, 8 << 20


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row of each byte, byte position in the lower-cased text); rows are parted by a 0 byte."""
    data, off = raw(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = WORD_BYTE[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    head = off[:-1][off[:-1] < off[1:]]
    keep[head] = True  # the first byte of a row is kept, and becomes the mark between rows if it is no word byte
    at = np.flatnonzero(keep)
    out = np.where(word[at], data[at], np.uint8(32))
    row = np.searchsorted(off, at, "right") - 1
    first = np.searchsorted(at, head)
    out, row, at = np.insert(out, first, 0), np.insert(row, first, row[first]), np.insert(at, first, at[first])
    return out, row, at - off[row]


@dataclass
class Index:
    """q-gram index of some benchmark items."""

    ids: np.ndarray
    text: np.ndarray  # normalised bytes of all items, with marks
    first: np.ndarray  # first byte of each item
    size: np.ndarray  # its length
    window: np.ndarray  # window, edit budget and least count of each item
    budget: np.ndarray
    least: np.ndarray
    keys: np.ndarray  # sorted distinct q-gram hashes, and their postings
    begin: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    bits: np.ndarray


def build(ids: list[int], texts: list[str], q: int = Q, window: int = WINDOW, edits: float = EDITS) -> Index:
    data, row, _ = normalised(pa.array(texts, pa.large_string()))
    first = np.searchsorted(row, np.arange(len(ids))) + 1
    size = np.maximum(np.searchsorted(row, np.arange(len(ids)), "right") - first, 0)
    # a trailing space is no part of an item
    for i in range(len(ids)):
        while size[i] and data[first[i] + size[i] - 1] == 32:
            size[i] -= 1
        while size[i] and data[first[i]] == 32:
            first[i] += 1
            size[i] -= 1
    n = np.minimum(size, window)
    e = np.floor(n * edits).astype(np.int64)
    e = np.minimum(e, np.maximum(n // q - 1, 0))
    least = np.maximum(n + 1 - q * (e + 1), 1)
    h = grams(data.astype(np.uint64) + np.uint64(1), q)
    at = np.concatenate([f + np.arange(max(s - q + 1, 0)) for f, s in zip(first, size)]) if len(ids) else np.zeros(0)
    at = at.astype(np.int64)
    of = np.repeat(np.arange(len(ids)), np.maximum(size - q + 1, 0))
    order = np.argsort(h[at], kind="stable")
    keys, begin = np.unique(h[at][order], return_index=True)
    bits = np.zeros(1 << 22, bool)
    bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return Index(np.array(ids, np.int64), data, first, size, n, e, least, keys, np.append(begin, len(at)).astype(np.int32), of[order].astype(np.int32), (at - first[of])[order].astype(np.int32), np.packbits(bits, bitorder="little"))


def banded(index: Index, data: np.ndarray, item: np.ndarray, ipos: np.ndarray, dpos: np.ndarray, slack: int) -> np.ndarray:
    """Least edits of each item window (from ipos) within the text from dpos - slack, by alignment in a band of 2 slack + 1 diagonals."""
    n = index.window[item]
    width = 2 * slack + 1
    padded = np.concatenate([np.full(slack + 1, 1, np.uint8), data, np.full(int(n.max()) + 3 * slack + 2, 1, np.uint8)])
    start = dpos + 1  # dpos - slack, in padded
    d = np.zeros((len(item), width), np.int16)
    done = np.full(len(item), 32767, np.int16)
    ramp = np.arange(width, dtype=np.int16)
    for i in range(int(n.max())):
        p = index.text[np.minimum(index.first[item] + ipos + i, len(index.text) - 1)]
        t = padded[np.minimum(start[:, None] + i + ramp, len(padded) - 1)]
        new = d + (t != p[:, None])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        end = n == i + 1
        done[end] = d[end].min(axis=1)
    return done


def find(index: Index, texts: pa.Array, q: int = Q) -> list[tuple[np.ndarray, ...]]:
    """(row, item, first byte in the lower-cased text, past byte, edits) of verified regions, one for each row and item."""
    data, row, at = normalised(texts)
    h = grams(data.astype(np.uint64) + np.uint64(1), q)
    if not len(h) or not len(index.keys):
        return []
    low = (h & np.uint64((1 << 22) - 1)).astype(np.int64)
    hit = np.flatnonzero((index.bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
    if not len(hit):
        return []
    k = np.minimum(np.searchsorted(index.keys, h[hit]), len(index.keys) - 1)
    same = index.keys[k] == h[hit]
    hit, k = hit[same], k[same]
    if not len(hit):
        return []
    count = (index.begin[k + 1] - index.begin[k]).astype(np.int64)
    post = np.repeat(index.begin[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
    dpos = np.repeat(hit, count)
    item, ipos = index.item[post].astype(np.int64), index.pos[post].astype(np.int64)
    # a row and item with fewer hits than the least count can't qualify
    pair = row[dpos] * len(index.ids) + item
    _, inv, cnt = np.unique(pair, return_inverse=True, return_counts=True)
    ok = cnt[inv] >= index.least[item]
    dpos, item, ipos = dpos[ok], item[ok], ipos[ok]
    if not len(dpos):
        return []
    e = int(index.budget.max())
    step = max(8, 2 * e)
    diag = dpos - ipos + int(index.size.max())
    band = diag // step
    extra = np.flatnonzero((diag % step < e) & (band > 0)) if e else np.zeros(0, np.int64)
    dpos, item, ipos, band = (np.concatenate([x, y]) for x, y in ((dpos, dpos[extra]), (item, item[extra]), (ipos, ipos[extra]), (band, band[extra] - 1)))
    order = np.lexsort((dpos, ipos, item, band))
    dpos, item, ipos, band = dpos[order], item[order], ipos[order], band[order]
    new = np.ones(len(dpos), bool)
    new[1:] = (ipos[1:] != ipos[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    dpos, item, ipos, band = dpos[new], item[new], ipos[new], band[new]
    last = np.arange(len(dpos)) + index.least[item] - 1
    inside = np.minimum(last, len(dpos) - 1)
    good = (last < len(dpos)) & (item[inside] == item) & (band[inside] == band) & (ipos[inside] - ipos <= index.window[item] - q)
    good = np.flatnonzero(good)
    if not len(good):
        return []
    # the window may begin before its first hit; its first q-grams may be hit by edits: begin where the budget allows
    item, ipos, dpos = item[good], ipos[good], dpos[good]
    out = []
    for back in range(0, 1 + e * q, q // 2):
        i0 = np.clip(ipos - back, 0, index.size[item] - index.window[item])
        d0 = dpos - (ipos - i0)
        edits = banded(index, data, item, i0, d0, step + e)
        yes = edits <= index.budget[item]
        if yes.any():
            out.append((item[yes], d0[yes], edits[yes]))
        item, ipos, dpos = item[~yes], ipos[~yes], dpos[~yes]
        if not len(item):
            break
    if not out:
        return []
    item, d0, edits = (np.concatenate(x) for x in zip(*out))
    d0 = np.clip(d0, 0, len(data) - 1)
    past = np.clip(d0 + index.window[item], 0, len(data)) - 1
    r = row[np.clip((d0 + past) // 2, 0, len(row) - 1)]
    result = []
    pair = r * len(index.ids) + item
    for key in np.unique(pair):
        own = pair == key
        rr = int(key // len(index.ids))
        inside = own & (row[d0] == rr)
        a = at[d0[inside]].min() if inside.any() else 0
        ends = past[own & (row[past] == rr)]
        b = at[ends].max() + 1 if len(ends) else at[row == rr].max() + 1
        result.append((rr, int(index.ids[key % len(index.ids)]), int(a), int(b), int(edits[own].min())))
    return result


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = INDEX_BYTES, **params) -> Iterator[Index]:
    """The benchmark's indexes, each of at most `limit` bytes of text (or one item), one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(ident(id_col).cast("long").alias("i"), ident(text_col).cast("string").alias("t"), F.octet_length(ident(text_col).cast("string")).alias("n")).where("i is not null and t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        if ids and size + r.n > limit:
            yield build(ids, texts, **params)
            ids, texts, size = [], [], 0
        ids.append(r.i), texts.append(r.t)
        size += r.n
    if ids:
        yield build(ids, texts, **params)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, first, past, edits): bytes [first, past) of the lower-cased text hold verified windows of the item."""
    kind = "doc_id long, item_id long, first long, past long, edits int"
    spark = docs.sparkSession
    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))
    result = None
    for index in indexes(benchmark, limit=limit):
        shared = spark.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in pieces(batch, "text"):
                    got = find(shared.value, b.column(1))
                    if got:
                        r, i, a, z, e = zip(*got)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(e, pa.int32())], ["doc_id", "item_id", "first", "past", "edits"])

        one = narrow.mapInArrow(lean(run), kind)
        result = one if result is None else result.unionByName(one)
    return result if result is not None else spark.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that leak an item; no join."""
    at = docs.columns.index(text_col)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.large_string())], ["text"])
                keep, n = np.ones(len(batch), bool), 0
                for b in pieces(one, "text"):
                    for r, *_ in find(shared.value, b.column(0)):
                        keep[n + r] = False
                    n += len(b)
                yield batch.filter(pa.array(keep))

        docs = map_rows(docs, run)
    return docs
