"""Toxic passages by maximum-scoring segments, with extreme-value calibration.

fit: token counts of labelled documents give each token a log-odds score between the toxic and the clean
class with an informative Dirichlet prior (the token's share of both classes, scaled).  A token is a
word, or a word beginning (`STEM` bytes), so unseen inflections score as their stem does.  Tokens whose log-odds
are significant form the lexicon; every other token shares one negative background score, and so does the
step between two words (`GAP`), so that passages end where hits get sparse.

scan: the linear-time all-maximal-segments algorithm runs over each whole text; for every segment with score S in a
text of n words, the expected number of as good segments in clean text is at most n exp(-lambda S), where
lambda is the positive root of sum p_i exp(lambda s_i) = 1 over the clean distribution of scores (the exponential
tail of the extreme-value law).  A document's value is the sum statistic of its segments: with
x = sum(lambda S_i - ln n) over the segments that raise it, the tail is exp(-x) x^(r-1) / (r! (r-1)!).

Cases: a null or empty text has no segment and p-value 1; labels that are null are not used; several labels of
a document count as toxic if one is; with no toxic or no clean training text, or no significant token, nothing is
flagged; of segments that tie the first is taken; very long texts are scanned whole; repeated rows are scored each; training texts with the same sequence of words count once, as toxic if one
of them is, and all others count each; extra columns are kept by `reject` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ident, lean, map_rows
from .words import mix, pieces, words

MAX_TRAIN = 20_000  #: bound of the labelled sample that the model is fitted on
PRIOR, MIN_Z, GAP, STEM, P_VALUE = 0.1, 3.5, 0.5, 5, 1e-3
_STEM_SALT = np.uint64(0xA5A5A5A55A5A5A5A)


@dataclass
class Model:
    """Sorted token hashes with scores, the background score, and the tail exponent."""

    keys: np.ndarray
    scores: np.ndarray
    background: float
    lam: float

    def lookup(self) -> np.ndarray:
        bits = np.zeros(1 << 16, bool)
        bits[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        return bits


def _tokens(batch: pa.RecordBatch, column: int):
    w = words(batch.column(column), prefix=STEM)
    return w, mix(w.prefix ^ _STEM_SALT)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """(key, toxic, tokens) of the sample; key is a hash of the whole sequence of words: the same for copies only."""
    sample = (
        labels.select(ident(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
        .groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    )
    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w, stem = _tokens(b, 1)
                at = w.first
                keys, lists = [], []
                for i in range(w.rows):
                    h = w.hash[at[i] : at[i + 1]]
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    lists.append(np.unique(np.concatenate([h, stem[at[i] : at[i + 1]]])).view(np.int64))
                size = np.array([len(x) for x in lists], np.int64)
                tokens = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(2), tokens.cast(pa.list_(pa.int64()))], ["key", "toxic", "tokens"])

    # the sample is bounded by max_train rows of two numbers
    return narrow.join(F.broadcast(sample), "id").select("id", "text", "toxic").mapInArrow(lean(run), "key binary, toxic int, tokens array<long>")


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lam s) = 1; the mean of s is negative and some s is positive."""
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    hi = 1.0
    while f(hi) < 0:
        hi *= 2
    lo = 0.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def scores(tox: np.ndarray, clean: np.ndarray, n_tox: float, n_clean: float, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and z of tokens counted tox and clean times among n_tox and n_clean, with a Dirichlet prior of the joint shares."""
    total = n_tox + n_clean
    a0 = prior * total
    a = a0 * (tox + clean) / total
    odds = np.log((tox + a) / (n_tox + a0 - tox - a)) - np.log((clean + a) / (n_clean + a0 - clean - a))
    return odds, odds / np.sqrt(1 / (tox + a) + 1 / (clean + a))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, min_z: float = MIN_Z, gap: float = GAP) -> Model | None:
    """The model, or None where the labels can't give one."""
    rows = _training(docs, labels, id_col, text_col, max_train)
    one = rows.groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("tokens").alias("tokens")).select("toxic", F.explode("tokens").alias("token"))
    counts = one.groupBy("token").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("tox"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("clean"))
    counts = counts.persist()
    try:
        n = counts.agg(F.sum("tox").alias("t"), F.sum("clean").alias("c")).first()
        if not n.t or not n.c:
            return None
        # a token can only be significant if the toxic class has several of it: the rest stays on the executors
        least = F.col("tox") * n.c > 4 * F.col("clean") * n.t
        got = counts.where((F.col("tox") >= 3) & least).toArrow()
    finally:
        counts.unpersist()
    key, tox, clean = (got[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("token", "tox", "clean"))
    odds, z = scores(tox.astype(float), clean.astype(float), float(n.t), float(n.c))
    good = (z >= min_z) & (odds > 2 * gap)
    if not good.any():
        return None
    key, odds, clean = key[good].view(np.uint64), odds[good] - gap, clean[good].astype(float)
    order = np.argsort(key)
    key, odds, clean = key[order], odds[order], clean[order]
    p = (clean + 0.5 / len(key)) / (n.c + 1)
    lam = _root(np.append(p, max(1e-9, 1 - p.sum())), np.append(odds, -gap))
    return Model(key, odds, -gap, lam)


def segments(score: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [i, j) of a sequence, in linear time (Ruzzo and Tompa)."""
    left: list[float] = []
    right: list[float] = []
    span: list[list[int]] = []
    prev: list[int] = []  # index of the nearest earlier candidate with a smaller left sum
    total = 0.0
    for i, s in enumerate(score):
        low, total = total, total + s
        if s <= 0:
            continue
        a, l, r = i, low, total
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = prev[j]
            if j < 0 or right[j] >= r:
                left.append(l), right.append(r), span.append([a, i + 1]), prev.append(j)
                break
            a, l = span[j][0], left[j]
            del left[j:], right[j:], span[j:], prev[j:]
    return [(a, b, r - l) for (a, b), l, r in zip(span, left, right)]


def sparse_segments(at: np.ndarray, s: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """Segments of a sequence that is `background` (negative) everywhere but s > 0 at positions `at`: the runs between fold into one item."""
    seq: list[float] = []
    for k in range(len(at)):
        if k and at[k] > at[k - 1] + 1:
            seq.append(background * float(at[k] - at[k - 1] - 1))
        elif k:
            seq.append(0.0)
        seq.append(float(s[k]))
    return [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, x) for a, b, x in segments(seq)]


def tail(xs: list[float]) -> float:
    """P-value of the best sum of the largest segments; xs: lambda S - ln n of each."""
    best, total = 1.0, 0.0
    for r, x in enumerate(sorted(xs, reverse=True), 1):
        total += x
        if x <= 0 or total <= 0:
            break
        log = -total + (r - 1) * math.log(max(total, 1e-12)) - math.lgamma(r + 1) - math.lgamma(r)
        # r segments were chosen among all: the choice of r costs a factor 2^r
        best = min(best, math.exp(min(0.0, log + (r - 1) * math.log(2))))
    return best


def _scan(model: Model | None):
    """Of a text column: word count, p-value and segments of each row."""
    look = model.lookup() if model else None

    def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list, "object"]:
        w = words(column, prefix=STEM)
        n = np.diff(w.first)
        p = np.ones(w.rows)
        found: list = [[] for _ in range(w.rows)]
        if model is None or not len(w.hash):
            return n, p, found, w
        stem = mix(w.prefix ^ _STEM_SALT)
        best = np.zeros(len(w.hash))
        for h in (w.hash, stem):
            k = np.flatnonzero(look[(h & np.uint64(0xFFFF)).astype(np.int64)])
            x = np.minimum(np.searchsorted(model.keys, h[k]), len(model.keys) - 1)
            ok = model.keys[x] == h[k]
            best[k[ok]] = np.maximum(best[k[ok]], model.scores[x[ok]])
        hit = np.flatnonzero(best > 0)
        if not len(hit):
            return n, p, found, w
        first = w.first
        rows, cut = np.unique(w.row[hit], return_index=True)
        for row, own in zip(rows, np.split(hit, cut[1:])):
            for a, b, s in sparse_segments(own - first[row], best[own], model.background):
                x = model.lam * s - math.log(max(n[row], 1))
                if x > 0:
                    found[row].append((a, b, s, x))
            p[row] = tail([x for *_, x in found[row]])
        return n, p, found, w

    return of


def passages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_value, toxic, n_words, segments) of every document: word spans [first, past), score and E-value of each significant segment."""
    scan = _scan(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for b in pieces(batch, "text"):
                n, p, found, _ = scan(b.column(1))
                segs = pa.array([[{"first": a, "past": z, "score": s, "e_value": math.exp(-x)} for a, z, s, x in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p < P_VALUE), pa.array(n.astype(np.int32)), segs], ["doc_id", "p_value", "toxic", "n_words", "segments"])

    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, p_value double, toxic boolean, n_words int, segments array<struct<first:int,past:int,score:double,e_value:double>>")


def reject(docs: DataFrame, model: Model | None, text_col: str = "text", p_value: float = P_VALUE) -> DataFrame:
    """docs, all columns, without the rows whose text is toxic; one pass, no join."""
    scan, at = _scan(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.large_string())
            one = pa.RecordBatch.from_arrays([text], ["text"])
            keep = [scan(b.column(0))[1] >= p_value for b in pieces(one, "text")]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return map_rows(docs, run)
