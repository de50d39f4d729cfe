"""SpotSigs: near copies by chains of content words that follow common words.

A signature is an anchor (a common word of four languages) with the CHAIN content words that follow it; content words are the words that
are no anchors.  A document is the set of its signatures; two documents are near copies if the Jaccard similarity of their sets
is at least `threshold`.  Every document is a query.

Plan: equal sets collapse to one by a 64-bit hash of the set.  By the prefix bound, sets with Jaccard t share one of the first n - ceil(t n) + 1
members in any fixed order, and the least member that they share is such a one for both: so each set is posted under
those members only.  The order is by value, but members that many documents of a sample share are renumbered to come last, the most frequent last of all:
otherwise a passage that a share of all documents holds makes groups that grow with the table, and work with their square.  The sample decides on work alone, not on links.  In the group of a member, sorted by set length, only lengths within the ratio t meet (partition by
length); a 128-bit sketch of least values prunes further, and pairs that share one of their
LEAD least members, if less than the group's, are left to that one's group.  Members with a surviving pair are joined with their sets and verified exactly; a
pair counts where the group's member is the least that both share, so nothing counts twice.  Pairs are not written: a group leaves a forest
of them, and the number of links of each set.  Postings travel as packed arrays, one for each target partition, not as rows.
Every reported link is exact.  The sketch makes the search for them approximate: its limit lies 5 standard deviations off, so it may lose one in
3.5 million of the pairs that lie just at the threshold, and fewer above it.

Cases: null texts and texts without a word are linked with nothing, and rows with a null id take no part; texts without a signature are linked only with
those of the same sequence of words: near copies among them are out of the method's reach; equal sets, and so repeated rows, are linked; rows of
one id are one document; ties don't matter; texts of any length are read whole; extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import Forest, per_document
from .shared import ident, lean, parts, written
from .words import Words, grams, hash_word, mix, pieces, words

THRESHOLD, CHAIN = 0.7, 3
ANCHORS = (
    "a an the of and to in is was are be for on that this it with as by at or from have has not but "
    "der die das den dem ein eine und ist im zu von mit auf für nicht sich des "
    "le la les un une des du de et est en que qui dans pour sur pas au par avec "
    "el los las una y es que del por con para se no su al lo"
).split()
LEAD = 4  #: least members that a posting carries
LARGE = 64  #: postings of a group that is compared on its own; smaller ones go together
SAMPLE = 16_384  #: documents, about, in which frequent members are looked for
OFTEN, MOST_FREQUENT = 3, 65_536  #: sets of the sample that hold a frequent member, at least; frequent members, at most
_RECORD = np.dtype([("sig", "<u4"), ("lead", "<u4", (LEAD,)), ("n", "<u4"), ("h", "<u8"), ("sketch", "<u8", (2,))])


def _anchor_hashes() -> np.ndarray:
    return np.sort(np.array([hash_word(w) for w in set(ANCHORS)], np.uint64))


class Order:
    """A permutation of the 32-bit numbers: those given become the greatest, in the order in which they are given."""

    def __init__(self, last: np.ndarray):
        last = last.astype(np.uint32)
        top = np.arange((1 << 32) - len(last), 1 << 32, dtype=np.uint64).astype(np.uint32)
        # what stood at the top takes the places that become free
        old = np.concatenate([last, np.setdiff1d(top, last)])
        new = np.concatenate([top, np.setdiff1d(last, top)])
        by = np.argsort(old)
        self.old, self.new = old[by], new[by]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.old & np.uint32(0xFFFFF)] = True

    def __call__(self, v: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[v & np.uint32(0xFFFFF)])
        if not len(at):
            return v
        k = np.minimum(np.searchsorted(self.old, v[at]), len(self.old) - 1)
        hit = self.old[k] == v[at]
        v = v.copy()
        v[at[hit]] = self.new[k[hit]]
        return v


def signatures(column: pa.Array, anchors: np.ndarray, chain: int = CHAIN, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, members): the sorted set of 32-bit signatures of each row."""
    return _signatures(words(column), anchors, chain, order)


def _signatures(w: Words, anchors: np.ndarray, chain: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    k = np.minimum(np.searchsorted(anchors, w.hash), len(anchors) - 1)
    is_anchor = anchors[k] == w.hash
    spot, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    g = grams(w.hash[content], chain)
    at = np.searchsorted(content, spot)
    ok = at < len(g)
    spot, at = spot[ok], at[ok]
    ok = w.row[content[at + chain - 1]] == w.row[spot]  # the chain ends in the anchor's document
    spot, at = spot[ok], at[ok]
    sig = mix(w.hash[spot] + g[at]) >> np.uint64(32)
    if order:
        sig = order(sig.astype(np.uint32)).astype(np.uint64)
    key = np.unique((w.row[spot].astype(np.uint64) << np.uint64(32)) | sig)
    return np.searchsorted(key >> np.uint64(32), np.arange(w.rows + 1)), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _set_hash(off: np.ndarray, members: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members.astype(np.uint64) + np.uint64(0x51ED)), dtype=np.uint64)])
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))


def _sketch(off: np.ndarray, members: np.ndarray) -> np.ndarray:
    """128 bits, in two words: of each of 128 buckets of a set, one bit of its least value."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    v = mix(members.astype(np.uint64))
    cell = (row << np.uint64(7)) | (v & np.uint64(127))
    key = np.sort((cell << np.uint64(32)) | ((v >> np.uint64(8)) & np.uint64(0xFFFFFFFF)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)
    key = key[first]
    bits = np.zeros((len(off) - 1) * 128, bool)
    bits[(key >> np.uint64(32)).astype(np.int64)] = (mix(key & np.uint64(0xFFFFFFFF)) & np.uint64(1)).astype(bool)
    return np.packbits(bits.reshape(-1, 128), axis=1, bitorder="little").view(np.uint64)


def sketch_limit(threshold: float) -> int:
    """Most bits in which the sketches of sets with that Jaccard differ, but for 5 standard deviations."""
    p = (1 - threshold) / 2
    return math.ceil(128 * p + 5 * math.sqrt(128 * p * (1 - p)))


def _postings(off: np.ndarray, members: np.ndarray, threshold: float) -> np.ndarray:
    n = np.diff(off)
    prefix = np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
    row = np.repeat(np.arange(len(n)), prefix)
    at = np.repeat(off[:-1] - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())
    out = np.empty(len(row), _RECORD)
    out["sig"], out["n"], out["h"], out["sketch"] = members[at], n[row], _set_hash(off, members)[row], _sketch(off, members)[row]
    for k in range(LEAD):
        out["lead"][:, k] = np.where(n[row] > k, members[np.minimum(off[row] + k, len(members) - 1)], 0xFFFFFFFF) if len(row) else 0
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of equal keys with at least two members."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(edge)
    return edge[:-1][size > 1], size[size > 1]


def _elsewhere(rec: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of postings of one member each, but for those that share a lesser one among their first."""
    sig = rec["sig"][a]
    for x in range(LEAD):
        for y in range(LEAD):
            mine = rec["lead"][a, x]
            other = (mine != rec["lead"][b, y]) | (mine >= sig)
            a, b, sig = a[other], b[other], sig[other]
    return a, b


def _few(rec: np.ndarray, start: np.ndarray, size: np.ndarray, threshold: float, limit: int, keep: np.ndarray) -> None:
    """Mark in keep the postings of small groups that have a pair worth a look: all pairs of many groups at a time."""
    i = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    later = np.repeat(start + size, size) - i - 1  # of each posting, those after it in its group
    i, later = i[later > 0], later[later > 0]
    total = np.concatenate([[0], np.cumsum(later)])
    x = 0
    while x < len(i):
        y = max(x + 1, int(np.searchsorted(total, total[x] + (1 << 19), "right")) - 1)
        a = np.repeat(i[x:y], later[x:y])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[x:y] - total[x], later[x:y])
        near = rec["n"][a] >= threshold * rec["n"][b] - 1e-9
        a, b = a[near], b[near]
        p, q = rec["sketch"][a], rec["sketch"][b]
        near = np.bitwise_count(p ^ q).sum(1, np.uint8) <= limit
        a, b = _elsewhere(rec, a[near], b[near])
        keep[a] = keep[b] = True
        x = y


def surviving(rec: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, set) of the postings that have a pair worth a look."""
    rec = rec[np.lexsort((rec["h"], rec["n"], rec["sig"]))]
    if len(rec):
        same = np.concatenate([[False], (rec["h"][1:] == rec["h"][:-1]) & (rec["sig"][1:] == rec["sig"][:-1])])
        rec = rec[~same]
    keep = np.zeros(len(rec), bool)
    limit = sketch_limit(threshold)
    start, size = _groups(rec["sig"])
    _few(rec, start[size < LARGE], size[size < LARGE], threshold, limit, keep)
    for first, large in zip(start[size >= LARGE].tolist(), size[size >= LARGE].tolist()):
        g = slice(first, first + large)
        n, lead, sketch, sig = rec["n"][g].astype(np.int64), rec["lead"][g, 0].copy(), rec["sketch"][g], rec["sig"][first]
        step = max(1, (1 << 20) // large)
        for i in range(0, large, step):
            j = i + step
            stop = int(np.searchsorted(n, n[min(j, large) - 1] / threshold + 1e-9, "right"))
            # bit counts are bytes, of at most 64 each: their sum fits
            near = np.bitwise_count(sketch[i:j, None, 0] ^ sketch[None, i:stop, 0]) + np.bitwise_count(sketch[i:j, None, 1] ^ sketch[None, i:stop, 1]) <= limit
            near &= n[i:j, None] >= threshold * n[None, i:stop] - 1e-9
            near &= np.arange(i, stop)[None, :] > np.arange(i, min(j, large))[:, None]
            # where the first members are equal and less, as in groups of copies, most pairs go at once
            near &= (lead[i:j, None] != lead[None, i:stop]) | (lead[i:j, None] >= sig)
            a, b = np.nonzero(near)
            a, b = _elsewhere(rec, a + i + first, b + i + first)
            keep[a] = keep[b] = True
    return rec["sig"][keep], rec["h"][keep]


def verified(sig: int, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of a group whose least shared member is sig, some at a time."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    flat = np.concatenate([sets[k] for k in order])
    row = np.repeat(np.arange(len(n)), n)
    value, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    row, at = row[shared], at[shared]
    _, at = np.unique(at, return_inverse=True)
    small = flat[shared] < sig
    step = 512
    for i in range(0, len(n), step):
        j = min(i + step, len(n))
        stop = int(np.searchsorted(n, n[j - 1] / threshold + 1e-9, "right"))
        both, less = np.zeros((j - i, stop - i), np.float32), np.zeros((j - i, stop - i), np.float32)
        mine = np.zeros(int(at.max()) + 1 if len(at) else 0, bool)
        mine[at[(row >= i) & (row < j)]] = True
        inside = (row >= i) & (row < stop)
        inside[inside] = mine[at[inside]]
        own, col, low = row[inside] - i, at[inside], small[inside]
        used, col = np.unique(col, return_inverse=True)
        width = max(256, (1 << 22) // max(1, stop - i))
        by = np.argsort(col, kind="stable")
        own, col, low = own[by], col[by], low[by]
        for c in range(0, len(used), width):
            x, y = np.searchsorted(col, (c, c + width))
            m = np.zeros((stop - i, min(width, len(used) - c)), np.float32)
            m[own[x:y], col[x:y] - c] = 1
            both += m[: j - i] @ m.T
            if low[x:y].any():
                m[:] = 0
                z = low[x:y]
                m[own[x:y][z], col[x:y][z] - c] = 1
                less += m[: j - i] @ m.T
        jac = both / np.maximum(n[i:j, None] + n[None, i:stop] - both, 1)
        a, b = np.nonzero((jac >= threshold - 1e-6) & (less == 0) & (np.arange(i, stop)[None, :] > np.arange(i, j)[:, None]))
        inter = both[a, b].astype(np.int64)
        exact = inter / (n[a + i] + n[b + i] - inter)
        good = exact >= threshold - 1e-12
        if good.any():
            yield order[a + i][good], order[b + i][good]


def frequent(narrow: DataFrame, anchors: np.ndarray, chain: int, sample: int = SAMPLE) -> np.ndarray:
    """Members that many different sets of a sample of (id, text) hold, the most frequent last."""
    one_in = max(1, narrow.count() // sample)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                off, members = signatures(b.column(1), anchors, chain)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(off, members).view(np.int64)), pa.ListArray.from_arrays(off.astype(np.int32), members.astype(np.int64))], ["h", "members"])

    some = narrow.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(one_in)) == 0)
    found = some.mapInArrow(lean(drawn), "h long, members array<long>").dropDuplicates(["h"]).select(F.explode("members").alias("sig")).groupBy("sig").count()
    rows = found.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "sig").limit(MOST_FREQUENT).collect()
    return np.array([r.sig for r in reversed(rows)], np.uint32)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """(doc_id, class_id, n_links) of every row with an id: the least id of its group of near copies, and the number of its near copies."""
    anchors, n_parts = _anchor_hashes(), parts(docs.sparkSession)
    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text")).where("id is not null")
    last = frequent(narrow, anchors, chain)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, rest): the hash of the set of signatures and 0; without a signature, 127 bits of that of the sequence of words, or nulls without a word."""
        order = Order(last)
        for batch in batches:
            for b in pieces(batch, "text"):
                w = words(b.column(1))
                off, members = _signatures(w, anchors, chain, order)
                first, n = w.first, np.diff(off)
                h, rest = _set_hash(off, members).view(np.int64), np.zeros(w.rows, np.int64)
                none = (n == 0) & (np.diff(first) == 0)
                for k in np.flatnonzero((n == 0) & ~none):
                    x = hashlib.blake2b(w.hash[first[k] : first[k + 1]].tobytes(), digest_size=16).digest()
                    h[k], rest[k] = int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True) | 1
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, mask=none), pa.array(rest, mask=none)], ["id", "h", "rest"])

    def sets(batches: Iterator[pa.RecordBatch]):
        order = Order(last)
        for batch in batches:
            for b in pieces(batch, "text"):
                yield signatures(b.column(1), anchors, chain, order)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for off, members in sets(batches):
            rec = _postings(off, members, threshold)
            part = (mix(rec["sig"].astype(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
            rec, part = rec[np.argsort(part, kind="stable")], np.sort(part)
            edge = np.searchsorted(part, np.arange(n_parts + 1))
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rec[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], ["part", "rec"])

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(p, np.frombuffer(x, _RECORD)) for b in batches for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        for part in sorted({p for p, _ in got}):
            sig, h = surviving(np.concatenate([x for p, x in got if p == part]), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig.astype(np.int64))], ["h", "sig"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for off, members in sets(batches):
            full = np.flatnonzero(np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(_set_hash(off, members)[full].view(np.int64)), pa.array([members[off[k] : off[k + 1]].tobytes() for k in full], pa.binary())], ["h", "members"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict] = {}
        for b in batches:
            for sig, h, members, i, copies in zip(*(b.column(c).to_pylist() for c in range(5))):
                own.setdefault(sig, {})[h] = i, copies, members
        while own:
            sig, rows = own.popitem()
            if len(rows) < 2:
                continue
            rows = sorted((i, h, copies, members) for h, (i, copies, members) in rows.items())
            ids, h, copies = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            forest = Forest(len(rows))
            for i, j in verified(sig, [np.frombuffer(r[3], np.uint32) for r in rows], threshold):
                forest.add(i, j, copies)
            if forest.met.any():
                yield forest.rows(ids, h=h, rest=np.zeros(len(h), np.int64))

    rows = written(narrow.mapInArrow(lean(keys), "id long, h long, rest long"))
    points = written(rows.where("h is not null").groupBy("h", "rest").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    candidates = written(narrow.mapInArrow(lean(post), "part int, rec binary").repartition(n_parts, "part").mapInArrow(lean(survive), "h long, sig long"))
    members = candidates.groupBy("h").agg(F.collect_list("sig").alias("sigs"))
    whole = narrow.mapInArrow(lean(packed), "h long, members binary").join(members.select("h"), "h", "left_semi").dropDuplicates(["h"])
    joined = whole.join(members, "h").join(points.where("rest = 0"), "h").select(F.explode("sigs").alias("sig"), "h", "members", "id", "copies")
    found = joined.repartition(n_parts, "sig").mapInArrow(lean(verify), "id long, root long, n long, h long, rest long")
    return per_document(rows, points, found, ["h", "rest"])
