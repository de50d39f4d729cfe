"""Byte-level BPE: encoding and decoding with a public vocabulary of ranks.

Encoding: whole texts are cut into words by the vocabulary's pattern; the COMMON words of a sample are folded once for all
tasks; a task numbers its other distinct words as they come (anew after KNOWN of them), and sends each once; Spark higher-order functions fold the ranked merges over the byte array of each; the words' ids are then laid
out along the texts.  The rank map is a literal row: sparse rows of a matrix displaced into one array of longs, so a look-up is two array reads.
A pair (a, b) of token ids maps to the id of the joined token, whose id is its rank.  A row holds about BLOCK_BYTES of text and at
most ROW_WORDS words, so memory doesn't follow the size of a partition.  The texts are not shuffled, and nothing broadcast grows with the corpus.
Words over LONG bytes, for which a fold's copying would be quadratic, are merged by a heap, with equal results.

Decoding: ids are mapped to their binary pieces by a literal array, and the pieces are concatenated.

Cases: a null text has null ids and decodes to null; an empty text has no ids; ids outside the vocabulary raise an error; texts of
any length are encoded whole; repeated rows are each encoded; extra columns are ignored by `encode`; an empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ident, lean, parts, release, written
from .words import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG, BLOCK_BYTES, ROW_WORDS, KNOWN = 256, 1 << 20, 1 << 15, 300_000
COMMON, SAMPLE_BYTES = 200_000, 64 << 20  #: words folded once for all tasks, and the bytes of text in which they are looked for
_BITS, _EMPTY = 21, 1 << 62
_NONE = (1 << _BITS) - 1


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _loaded(path: str):
    """(ranks, folder) of a vocabulary; made once for a driver."""
    ranks = load(path)
    made = ranks, folder(ranks)
    release()
    return made


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) -> id of the joined token, for every split of every token."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def displaced(pairs: dict[tuple[int, int], int], n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each id, table): the row of id a is laid into the table from offset[a], so that no two rows meet.

    table[offset[a] + b] is a << 21 | id of a + b for a pair, and a << 21 of another row, or 2**62, for no pair.
    The id n_ids is a guard: it merges with nothing.
    """
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    size = 3 * len(pairs) + 4 * n_ids + 64
    free = np.ones(size, bool)
    table = np.full(size + n_ids + 2, _EMPTY, np.int64)
    offset = np.zeros(n_ids + 1, np.int64)
    low = 0  # every cell below is taken
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        b = np.array(sorted(rows[a]))
        while not free[low]:
            low += 1
        if len(b) == 1 and low >= b[0]:
            at = low - b[0]
        else:
            start = max(0, low - int(b[0]))
            while True:
                cells = free[start + b[0] : start + b[0] + 4096]
                tries = start + np.flatnonzero(cells)
                for x in b[1:]:
                    tries = tries[free[np.minimum(tries + x, size - 1)]]
                    if not len(tries):
                        break
                if len(tries):
                    at = tries[0]
                    break
                start += 4096
        offset[a] = at
        free[at + b] = False
        table[at + b] = [(a << _BITS) | pairs[a, int(x)] for x in b]
    last = int(np.flatnonzero(~free).max()) if pairs else 0
    empty = last + 1  # ids without a row, and the guard, look at the empty end
    offset[[a for a in range(n_ids + 1) if a not in rows]] = empty
    return offset, table[: empty + n_ids + 2]


def folder(ranks: dict[bytes, int]):
    """The rank map, as columns of one row, and a function from it and the byte array of a word to the word's items: a fold of the ranked merges.

    The byte array is that of `bigrams`: each cell holds a byte and the one after it.  An item is a token of the word so far: the id that it
    would have if merged with the next one, its place, and its own id, 21 bits each, so the least item is the leftmost pair of the least rank.
    The map is large, so an expression should hold it once: bind it to a lambda variable, as `_folded` does.
    """
    n_ids = max(ranks.values()) + 1
    assert n_ids < _NONE
    pairs = merges(ranks)
    offset, table = displaced(pairs, n_ids)
    own = [ranks[bytes([i])] for i in range(256)]
    first = [(pairs.get((a, b), _NONE) << 2 * _BITS) | a for a in own for b in own]
    first += [(_NONE << 2 * _BITS) | a for a in [*own, n_ids]]  # the last byte of a word, and the guard
    row = pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in (("offset", offset), ("table", table), ("first", first))})
    none, past = F.lit(_NONE).cast("long"), F.lit(_NONE << 2 * _BITS).cast("long")

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), 0)

    def rank(m: Column, a: Column, b: Column) -> Column:
        """The id of a + b, or _NONE."""
        return F.least(F.get(m["table"], F.get(m["offset"], a) + b).bitwiseXOR(F.shiftleft(a, _BITS)), none)

    def id_of(item: Column) -> Column:
        return item.bitwiseAND(none)

    def merge(m: Column, items: Column) -> Column:
        def at_(low: Column) -> Column:
            def join(at: Column) -> Column:  # the guards make sure that the pair has neighbours
                joined = F.shiftright(low, 2 * _BITS)

                def beside(before: Column) -> Column:
                    left = F.shiftleft(rank(m, id_of(before), joined), 2 * _BITS) + before.bitwiseAND(F.lit((1 << 2 * _BITS) - 1).cast("long"))
                    right = F.shiftleft(rank(m, joined, id_of(F.get(items, at + 1))), 2 * _BITS) + low.bitwiseAND(F.lit(_NONE << _BITS).cast("long")) + joined
                    # items differ by their place, so each is removed alone; slices would be slower
                    rest = F.array_remove(F.array_remove(F.array_remove(items, low), before), F.get(items, at))
                    return F.array_insert(F.array_insert(rest, at - 1, right), at - 1, left)

                return let(F.get(items, at - 2), beside)

            return F.when(low >= past, items).otherwise(let(F.array_position(items, low).cast("int"), join))

        return let(F.array_min(items), at_)

    def of(m: Column, word: Column) -> Column:
        start = F.transform(word, lambda c, i: F.get(m["first"], c) + F.shiftleft(i.cast("long"), _BITS))
        return F.aggregate(F.slice(word, F.lit(3), F.lit(1 << 30)), start, lambda items, _: merge(m, items))

    return row, of


def bigrams(words_: list[bytes]) -> pa.ListArray:
    """The byte array of each word for the fold: a guard, each byte with the next one, the last byte, a guard; empty for an empty word."""
    flat = np.frombuffer(b"".join(words_), np.uint8).astype(np.int32)
    size = np.fromiter(map(len, words_), np.int64, len(words_))
    full = size > 0
    edge = np.concatenate([[0], np.cumsum(size + 2 * full)])
    out = np.full(edge[-1], 65536 + 256, np.int32)
    place = np.arange(len(flat)) + np.repeat(edge[:-1] + 1 - (np.cumsum(size) - size), size)
    code = np.empty(len(flat), np.int32)
    code[:-1] = flat[:-1] * 256 + flat[1:]
    last = np.cumsum(size)[full] - 1
    code[last] = 65536 + flat[last]
    out[place] = code
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(out))


def heap_encode(word: bytes, pairs: dict[tuple[int, int], int], ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word of any length, in n log n time: the leftmost pair of the least rank merges first."""
    ids = [ranks[word[i : i + 1]] for i in range(len(word))]
    n = len(ids)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], nxt[i] = r, -1, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (x := pairs.get((r, ids[nxt[i]]))) is not None:
                heapq.heappush(heap, (x, i, r, ids[nxt[i]]))
        if prev[i] >= 0 and (x := pairs.get((ids[prev[i]], r))) is not None:
            heapq.heappush(heap, (x, prev[i], ids[prev[i]], r))
    return [x for x in ids if x >= 0]


def _flat(words_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of the words of an array of folded items, without the guards."""
    edge = words_.offsets.to_numpy().astype(np.int64)
    ranked = words_.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]] & _NONE
    edge -= edge[0]
    inner = np.ones(len(ranked), bool)
    full = np.flatnonzero(np.diff(edge))
    inner[edge[full]] = inner[edge[full + 1] - 1] = False
    return ranked[inner].astype(np.int32), np.maximum(np.diff(edge) - 2, 0)


def common(narrow: DataFrame, vocabulary: str, pattern: str, long: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, ids, number of ids) of at most COMMON words that are common in about SAMPLE_BYTES of the texts, folded once for all tasks.

    It only saves time: words that are not here are folded by the tasks that meet them.
    """
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = round(100_000 * min(1.0, SAMPLE_BYTES / max(total, 1)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, found = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(find(text))
        some = [w for w, n in found.items() if len(w) * 4 <= long]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([found[w] for w in some], pa.int64())], ["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1 << 12):
                own = batch.column(0).slice(a, 1 << 12)
                cells = own, bigrams([w.encode() for w in own.to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x) for x in cells], ["text", "words"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, items in zip(batch.column(0), batch.column(1)):
                cells = text.values, *map(pa.array, _flat(items.values))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cells], ["text", "ids", "n"])

    sample = narrow.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(100_000)) < share).select("text")
    top = written(sample.mapInArrow(lean(counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).select("word"))
    folded = _folded(top.repartition(parts(narrow.sparkSession)).mapInArrow(rows, "text array<string>, words array<array<int>>"), vocabulary).select("text", "items")
    got = folded.mapInArrow(flat, "text array<string>, ids array<int>, n array<long>").toArrow()
    text, ids, n = (pa.concat_arrays([c.flatten() for c in got[k].chunks]) if len(got) else pa.array([], kind) for k, kind in (("text", pa.string()), ("ids", pa.int32()), ("n", pa.int64())))
    return text, ids.to_numpy(), n.to_numpy()


def _folded(df: DataFrame, vocabulary: str) -> DataFrame:
    """df with the items of its column `words`.  The rank map is a literal relation of one row, which a scalar subquery binds to a variable of the fold.

    As a literal inside the expression it would be printed, 4 MB at a time, in every description of the plan that the driver keeps.
    """
    row, fold = _loaded(vocabulary)[1]
    ranks = df.sparkSession.createDataFrame(row).select(F.struct(*row.column_names)).scalar()
    items = F.get(F.transform(F.array("ranks"), lambda m: F.transform("words", lambda w: fold(m, w))), 0)
    return df.withColumn("ranks", ranks).withColumn("items", items).drop("ranks", "words")


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, long: int, base: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of some texts each: their ids and check sums, the words that are new in this task, and the number of each word of each text.

    The numbers start anew where `fresh` is set, so neither side of the fold holds more than KNOWN words and those of one text.
    """
    import regex

    find = regex.compile(pattern).findall
    kind = pa.schema([("fresh", pa.bool_()), ("id", pa.list_(pa.int64())), ("crc", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("words", pa.list_(pa.list_(pa.int32()))), ("long", pa.list_(pa.binary())), ("at", pa.binary())])
    first = dict(zip(base.to_pylist(), range(len(base))))
    known = first.copy()
    fresh = True

    def row(words_: list[str], ids: list, crcs: list, counts: list, at: bytes) -> pa.RecordBatch:
        nonlocal fresh
        own = [w.encode() for w in words_]
        big = [w if len(w) > long else None for w in own]
        arrays = bigrams([b"" if x else w for w, x in zip(own, big)])
        whole = pa.ListArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), arrays)
        cells = [pa.array([x], kind.field(c).type) for x, c in ((fresh, "fresh"), (ids, "id"), (crcs, "crc"), (counts, "n"), (big if any(big) else [], "long"), (at, "at"))]
        fresh = False
        return pa.RecordBatch.from_arrays([*cells[:4], whole, *cells[4:]], schema=kind)

    for batch in batches:
        for b in pieces(batch, "text", BLOCK_BYTES):
            if len(known) - len(first) > KNOWN:
                known, fresh = first.copy(), True
            before, get = len(known), known.setdefault
            crcs, counts, at = [], [], []
            for text in b.column(1).to_pylist():
                found = find(text) if text else []
                crcs.append(None if text is None else zlib.crc32(text.encode())), counts.append(None if text is None else len(found))
                at.append(np.fromiter((get(w, len(known)) for w in found), np.int32, len(found)))
            new = list(islice(known, before, None))
            while len(new) > ROW_WORDS:
                yield row(new[:ROW_WORDS], [], [], [], b"")
                del new[:ROW_WORDS]
            yield row(new, b.column(0).to_pylist(), crcs, counts, pa.compress(np.concatenate(at).tobytes(), codec="lz4", asbytes=True))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, long: int = LONG) -> DataFrame:
    """(doc_id, ids, n_tokens, crc): the token ids of every row's text, and the CRC-32 of its bytes."""
    ranks, _ = _loaded(vocabulary)
    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))
    base = docs.sparkSession.sparkContext.broadcast(common(narrow, vocabulary, pattern, long))  # at most COMMON words
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: its size doesn't depend on the corpus

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = None
        _, ids_0, size_0 = base.value
        flat, begin, size = ids_0, np.cumsum(size_0) - size_0, size_0
        for batch in batches:
            for k in range(len(batch)):
                fresh, ids, crc, n, at = (batch.column(c)[k] for c in range(5))
                if fresh.as_py():
                    flat, begin, size = ids_0, np.cumsum(size_0) - size_0, size_0
                own, sizes = _flat(batch.column(5)[k].values)
                starts = len(flat) + np.cumsum(sizes) - sizes
                rest = batch.column(6)[k].values
                big = np.flatnonzero(rest.is_valid().to_numpy(zero_copy_only=False)) if len(rest) else []
                if len(big):  # long words
                    pairs = pairs or merges(shared.value)
                    more = [np.array(heap_encode(rest[int(i)].as_py(), pairs, shared.value), np.int32) for i in big]
                    starts[big] = len(flat) + len(own) + np.concatenate([[0], np.cumsum([len(x) for x in more])[:-1]]).astype(np.int64)
                    sizes[big] = [len(x) for x in more]
                    own = np.concatenate([own, *more])
                flat, begin, size = np.concatenate([flat, own]), np.concatenate([begin, starts]), np.concatenate([size, sizes])
                if not len(ids.values):
                    continue
                null = n.values.is_null().to_numpy(zero_copy_only=False)
                counts = n.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(counts)])
                at = np.frombuffer(pa.decompress(at.as_py(), 4 * int(edge[-1]), codec="lz4", asbytes=True), np.int32)
                ids, crc = ids.values, crc.values
                step, low = 1 << 20, 0
                while low < len(counts):  # some texts at a time
                    high = max(low + 1, int(np.searchsorted(edge, edge[low] + step, "right")) - 1)
                    high = min(high, len(counts))
                    w = at[edge[low] : edge[high]]
                    s = size[w]
                    total = np.concatenate([[0], np.cumsum(s)])
                    tokens = flat[np.repeat(begin[w] - total[:-1], s) + np.arange(total[-1])]
                    offsets = total[edge[low : high + 1] - edge[low]].astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=pa.array(null[low:high]))
                    number = pa.array(np.diff(offsets).astype(np.int32), mask=null[low:high])
                    yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), made, number, crc.slice(low, high - low)], ["doc_id", "ids", "n_tokens", "crc"])
                    low = high

    blocks = narrow.mapInArrow(lean(lambda it: _blocks(it, pattern, long, base.value[0])), "fresh boolean, id array<long>, crc array<long>, n array<int>, words array<array<int>>, long array<binary>, at binary")
    # a word over `long` bytes has an empty array here
    return _folded(blocks, vocabulary).select("fresh", "id", "crc", "n", "at", "items", "long").mapInArrow(lean(lay_out), "doc_id long, ids array<int>, n_tokens int, crc long")


def decoded(df: DataFrame, column: str = "ids", name: str = "bytes", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the bytes of a column of token ids: the concatenation of their binary pieces, each held as a string of Latin-1 in a literal row."""
    ranks, _ = _loaded(vocabulary)
    by_id = [""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        by_id[r] = token.decode("latin-1")
    row = pa.table({"piece": pa.array([by_id], pa.list_(pa.string()))})
    joined = F.get(F.transform(F.array("pieces"), lambda p: F.array_join(F.transform(column, lambda i: F.element_at(p, i + 1)), "")), 0)
    return df.withColumn("pieces", df.sparkSession.createDataFrame(row).scalar()).withColumn(name, F.encode(joined, "ISO-8859-1")).drop("pieces")


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; round_trip: its ids decode to the bytes that were encoded."""
    got = decoded(encode(docs, id_col, text_col, vocabulary), "ids", "bytes", vocabulary)
    return got.select("doc_id", "ids", "n_tokens", (F.crc32("bytes") == F.col("crc")).alias("round_trip"))
