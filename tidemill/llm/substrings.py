"""Passages that documents share: compressed FM-indexes per shard, backward search, matching statistics.

A word of a document is repeated if it lies in a run of `least` words that also stands in another document.  The result is every maximal
run of repeated words, and is exact.  Words are compared by 32-bit hash, lower case, without the punctuation between them.

Plan: winnowing selects word k-grams so that every run of `least` words holds one, and equal runs hold equal ones.  Grams that
two documents select mark the places worth indexing; the words that any run through such a gram can take (a window of 2 least - k words)
go to the gram's shard.  A shard indexes its distinct windows: suffix order by prefix doubling, Burrows-Wheeler transform, wavelet
matrix of 16 branches with rank counts.  Every window streams through backward search, all of a shard at a time, and keeps at
every end the longest match that another document has (the matching statistics); intervals of at least `least` words are
reported, and the intervals of a document are merged.  Windows are of constant length, so shards grow in number with the corpus, not the work a word.

Cases: null ids and texts take no part; texts under `least` words have no run; repeats within a document don't count, nor
do repeated rows of one id; extra columns are ignored; an empty table gives no rows; texts of any length are covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ident, lean, parts, written
from .words import grams, mix, pieces, words

LEAST, GRAM = 50, 16
_MARK = np.dtype([("fp", "<u8"), ("id", "<i8"), ("text", "<i8"), ("pos", "<u4")])
_SLICE, SHARDS = 2 << 20, 8  #: bytes of text at a time; shards of each shuffle partition, indexed one after another


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for every i with a whole window."""
    have, out = 1, x
    while 2 * have <= width:
        out = f(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return f(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def winnowed(h: np.ndarray, row: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram) of the grams that are the least of some run of `least` words of their row."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, width = grams(h, k), least - k + 1
    low = _sliding(g, width, np.minimum)
    low = np.where(row[: len(low)] == row[least - 1 :], low, np.uint64(0))  # runs over two rows don't count
    edge = np.zeros(width - 1, np.uint64)
    top = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero(top == g)
    return at, g[at]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` items, at least."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    # as many items as a word holds are compared at once, then twice as many in each round
    have = min(63 // bits, n)
    key = np.zeros(n, np.int64)
    for k in range(have):
        key <<= bits
        key[: n - k] |= text[k:] + 1
    rank = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        at = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(at[1:] != at[:-1], out=new[1:])
        rank[order] = new
        if have >= depth or new[-1] == n - 1:
            return order.astype(np.int32)
        key = rank * int(new[-1] + 2)
        key[: n - have] += rank[have:] + 1
        have *= 2


_ONES = np.uint64(0x1111111111111111)
_REPEATED = np.arange(16, dtype=np.uint64) * _ONES  #: a nibble, 16 times
_BELOW = np.array([(1 << 4 * k) - 1 for k in range(16)], np.uint64)  #: the first k nibbles


class FMIndex:
    """Backward search in a text of codes 0 .. sigma - 1, by a wavelet matrix with 16 branches a level.

    A level holds a nibble of every code, 16 of them in a word, and for every word how many of each nibble come before, so the rank of
    a nibble takes one look-up and a population count, and a step has a quarter of the levels that bits would need.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        last = text[self.order - 1].astype(np.uint32)  # the transform
        bits = max(1, int(text.max()).bit_length())
        self.shifts = [4 * k for k in reversed(range(-(-bits // 4)))]
        counts = np.bincount(last, minlength=1 << 4 * len(self.shifts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for shift in self.shifts:
            nibble = ((last >> np.uint32(shift)) & np.uint32(15)).astype(np.uint8)
            whole = np.concatenate([nibble, np.zeros(16 + (-len(nibble)) % 16, np.uint8)]).reshape(-1, 16)
            words_ = (whole[:, 0::2] | (whole[:, 1::2] << np.uint8(4))).copy().view("<u8")[:, 0]
            of = np.bincount((np.arange(len(nibble)) >> 4) * 16 + nibble, minlength=16 * len(words_)).astype(np.int32).reshape(-1, 16)
            before = np.zeros_like(of)
            np.cumsum(of[:-1], axis=0, out=before[1:])
            total = np.bincount(nibble, minlength=16)
            before += (np.cumsum(total) - total).astype(np.int32)  # where the nibble's block begins in the next level
            self.levels.append((words_, before.reshape(-1)))
            last = last[np.argsort(nibble, kind="stable")]
        # where each code's block begins after the last level, and in the order of suffixes
        codes = np.arange(1 << 4 * len(self.shifts), dtype=np.int32)
        self.move = self.first[:-1].astype(np.int32) - self._walk(codes, np.zeros(len(codes), np.int32))

    def _walk(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (words_, before) in zip(self.shifts, self.levels):
            c = (code >> shift) & 15
            w = at >> 4
            x = words_[w] ^ _REPEATED[c]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            x = ~x & _ONES & _BELOW[at & 15]
            at = before[(w << 4) + c] + np.bitwise_count(x)
        return at

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of code + pattern from that of the pattern."""
        move = self.move[code]
        both = self._walk(np.concatenate([code, code]), np.concatenate([lo, hi]))
        return both[: len(code)] + move, both[len(code) :] + move


def shared_runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first, past) of runs that windows of other owners hold.  Windows are flat[begin : begin + size]; they are distinct.

    owner: the document, or a negative number of its own for a window that several documents have.
    """
    codes, text = np.unique(flat, return_inverse=True)
    total = len(flat) + len(begin)
    text = text.astype(np.int32)
    joined = np.zeros(total, np.int64)  # code 0 ends each window
    where = np.repeat(np.arange(len(begin)), size)
    joined[np.arange(len(flat)) + where] = text + 1
    own = np.empty(total, np.int32)
    own[np.arange(len(flat)) + where] = owner[where]
    own[np.cumsum(size) + np.arange(len(begin))] = owner
    del where
    ix = FMIndex(joined, int(size.max()) + 1)
    del joined
    label = own[ix.order]
    new = label[1:] != label[:-1]
    ends = np.append(np.flatnonzero(new) + 1, total).astype(np.int32)
    run = np.zeros(total, np.int32)
    np.cumsum(new, out=run[1:])
    change = ends[run]  # where the run of equal labels ends
    del own, new, run, ends
    # several documents have it: it is shared as a whole
    full = np.flatnonzero((owner < 0) & (size >= least))
    out = [(full, np.zeros(len(full), np.int64), size[full])]
    q = np.flatnonzero((owner >= 0) & (size >= least))
    end = size[q] - 1
    i, lo, hi = end.copy(), np.zeros(len(q), np.int32), np.full(len(q), total, np.int32)
    while len(q):
        code = text[begin[q] + i] + 1
        a, b = ix.step(code, lo, hi)
        safe = np.minimum(a, total - 1)
        ok = (b > a) & ((label[safe] != owner[q]) | (change[safe] < b))
        lo, hi = np.where(ok, a, np.int32(0)), np.where(ok, b, np.int32(total))
        i = np.where(ok, i - 1, i)
        stop = ~ok | (i < 0)
        far = stop & (end - i >= least)
        if far.any():
            out.append((q[far], i[far] + 1, end[far] + 1))
        # a run that goes further left ends at most least - 1 words right of the mismatch
        end = np.where(stop, np.where(end - i >= least, np.minimum(end - 1, i + least - 1), end - 1), end)
        lo, hi = np.where(stop, np.int32(0), lo), np.where(stop, np.int32(total), hi)
        on = ~(stop & ((end < least - 1) | (i < 0)))
        i = np.where(stop, end, i)
        q, end, i, lo, hi = q[on], end[on], i[on], lo[on], hi[on]
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = GRAM) -> DataFrame:
    """(doc_id, first, past): the maximal runs [first, past) of repeated words of every document."""
    n_parts = parts(docs.sparkSession)
    n_shards = n_parts * SHARDS
    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    keyed = narrow.select("id", F.xxhash64("text").alias("key"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", _SLICE):
                w = words(b.column(2))
                at, g = winnowed(w.hash, w.row, least, k)
                rec = np.empty(len(at), _MARK)
                row = w.row[at]
                ids, key = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                rec["fp"], rec["id"], rec["text"], rec["pos"] = g, ids[row], key[row], at - w.first[row]
                part = (g % np.uint64(n_parts)).astype(np.int32)
                rec, part = rec[np.argsort(part, kind="stable")], np.sort(part)
                edge = np.searchsorted(part, np.arange(n_parts + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rec[edge[x] : edge[x + 1]].tobytes() for x in full], pa.binary())], ["part", "rec"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.setdefault(p, []).append(np.frombuffer(x, _MARK))
        while got:
            rec = np.concatenate(got.popitem()[1])
            rec = rec[np.lexsort((rec["pos"], rec["text"], rec["id"], rec["fp"]))]
            new = np.ones(len(rec), bool)
            new[1:] = rec["fp"][1:] != rec["fp"][:-1]
            group = np.cumsum(new) - 1
            many = np.zeros(len(rec), bool)
            many[1:] = ~new[1:] & (rec["id"][1:] != rec["id"][:-1])
            rec = rec[(np.bincount(group, weights=many) > 0)[group]] if len(rec) else rec
            rec = rec[np.lexsort((rec["text"], rec["id"]))]
            if not len(rec):
                continue
            cut = np.flatnonzero((rec["id"][1:] != rec["id"][:-1]) | (rec["text"][1:] != rec["text"][:-1])) + 1
            edge = np.concatenate([[0], cut, [len(rec)]])
            for s in range(0, len(edge) - 1, 4096):
                e = edge[s : s + 4097]
                yield pa.RecordBatch.from_arrays([pa.array(rec["id"][e[:-1]]), pa.array(rec["text"][e[:-1]]), pa.array([rec["pos"][a:z].tobytes() for a, z in zip(e, e[1:])], pa.binary()), pa.array([rec["fp"][a:z].tobytes() for a, z in zip(e, e[1:])], pa.binary())], ["id", "key", "pos", "fp"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", _SLICE):
                w = words(b.column(1))
                first, h = w.first, (w.hash >> np.uint64(32)).astype(np.uint32)
                pos = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in b.column(2).to_pylist()]
                fp = np.concatenate([np.frombuffer(b"".join(x), np.uint64) for x in b.column(3).to_pylist()])
                row = np.repeat(np.arange(len(pos)), [len(x) for x in pos])
                pos = np.concatenate(pos)
                start = np.maximum(pos - (least - k), 0)
                size = np.minimum(pos + least, (first[1:] - first[:-1])[row]) - start
                part = (fp % np.uint64(n_shards)).astype(np.int64)
                order = np.lexsort((fp, part))  # equal windows lie beside each other
                row, start, size, part = row[order], start[order], size[order], part[order]
                words_ = h[np.repeat(first[row] + start - np.cumsum(size) + size, size) + np.arange(size.sum())]
                ids = b.column(0).to_numpy(zero_copy_only=False)[row]
                edge = np.searchsorted(part, np.arange(n_shards + 1))
                at = np.concatenate([[0], np.cumsum(size)])
                full = np.flatnonzero(np.diff(edge))
                cell = lambda x, kind: pa.array([x[edge[p] : edge[p + 1]].astype(kind).tobytes() for p in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cell(ids, "<i8"), cell(start, "<u4"), cell(size, "<u4"), pa.array([words_[at[edge[p]] : at[edge[p + 1]]].tobytes() for p in full], pa.binary())], ["part", "id", "start", "size", "words"])

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """The cells of each shard; rows come in the order of their shards."""
        last, got = None, []
        for b in batches:
            for p, *cells in zip(*(b.column(c).to_pylist() for c in range(5))):
                if p != last and got:
                    yield got
                    got = []
                last = p
                got.append(cells)
        if got:
            yield got

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in shards_of(batches):
            ids, start, size, flat = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*cells), ("<i8", "<u4", "<u4", "<u4")))
            del cells
            size, start = size.astype(np.int64), start.astype(np.int64)
            begin = np.cumsum(size) - size
            # distinct windows, by a hash of their words
            place = np.arange(len(flat)) - np.repeat(begin, size)
            key = np.add.reduceat(mix(flat.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), begin) + size.astype(np.uint64)
            del place
            _, one, kind = np.unique(key, return_index=True, return_inverse=True)
            low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
            np.minimum.at(low, kind, ids)
            np.maximum.at(high, kind, ids)
            names, number = np.unique(low, return_inverse=True)
            owner = np.where(low == high, number, -1 - np.arange(len(one)))
            s = size[one]
            distinct = flat[np.repeat(begin[one] - np.cumsum(s) + s, s) + np.arange(s.sum())]
            order = np.argsort(kind, kind="stable")
            edge = np.searchsorted(kind[order], np.arange(len(one) + 1))
            for win, a, z in shared_runs(distinct, np.cumsum(s) - s, s, owner, least):
                n = edge[win + 1] - edge[win]
                at = order[np.repeat(edge[win] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array((start[at] + np.repeat(a, n)).astype(np.int32)), pa.array((start[at] + np.repeat(z, n)).astype(np.int32))], ["doc_id", "first", "past"])

    marked = written(keyed.mapInArrow(lean(mark), "part int, rec binary").repartition(n_parts, "part").mapInArrow(lean(twice), "id long, key long, pos binary, fp binary"))
    of_doc = marked.groupBy("id", "key").agg(F.collect_list("pos").alias("pos"), F.collect_list("fp").alias("fp"))
    cut = keyed.join(of_doc, ["id", "key"]).select("id", "text", "pos", "fp").mapInArrow(lean(windows), "part int, id binary, start binary, size binary, words binary")
    runs = cut.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(lean(search), "doc_id long, first int, past int")
    # overlapping and touching runs of a document are one
    w = Window.partitionBy("doc_id").orderBy("first", "past")
    before = F.max("past").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.select("doc_id", "first", "past", F.when(F.col("first") <= before, 0).otherwise(1).alias("new")).select("doc_id", "first", "past", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return islands.groupBy("doc_id", "island").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("island")
