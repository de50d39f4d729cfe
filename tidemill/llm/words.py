"""Vectorised word segmentation and hashing of Arrow text columns.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes in the lower-cased text, so
punctuation and white space separate words and accented letters stay inside them.  A null text is an
empty text: it has no words.  Everything works on whole texts; batches are cut into slices of a few MB
between documents only to keep the temporary arrays small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SLICE_BYTES = 2 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in range(128):
    WORD_BYTE[_c] = chr(_c).isalnum()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POW[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p)
    return _POW[0][:n], _POW[1][:n]


@dataclass
class Words:
    """Words of some documents: row (of each word), byte start and end, 64-bit hash; text bytes; row offsets."""

    rows: int
    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if bufs[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Slices of a batch with about `limit` bytes of text each; a longer single text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = raw(col)
    a, n = 0, len(batch)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def words(texts: pa.Array, prefix: int = 0, lower: bool = True) -> Words:
    """Segment and hash a text column; with `prefix`, also hash each word's first `prefix` bytes."""
    texts = texts.cast(pa.large_string())
    data, off = raw(pc.utf8_lower(texts) if lower else texts)
    n = len(off) - 1
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = WORD_BYTE[data]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(inner):  # a word never crosses from one document into the next
        cut = inner[(flag[inner] == 1) & (flag[inner + 1] == 1)]
        if len(cut):
            start = np.insert(start, np.searchsorted(start, cut), cut)
            end = np.insert(end, np.searchsorted(end, cut), cut)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * q[start])
    pre = np.zeros(0, np.uint64)
    if prefix:
        pre = mix((total[np.minimum(end, start + prefix)] - total[start]) * q[start])
    row = np.searchsorted(off, start, "right") - 1
    return Words(n, data, off, row.astype(np.int64), start, end, h, pre)


def hash_word(word: str) -> int:
    """The hash of one word, as `words` gives it."""
    return int(words(pa.array([word])).hash[0])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items of h (len(h) - k + 1 of them; may cross documents)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * q[:n])
