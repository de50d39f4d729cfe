"""Operators that SQL doesn't cover: errors, resumption, casts, streams, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import blend, cast, episode, order, quality, text
from tidemill.sources import catalog
from tidemill.streaming import growing


def test_resume_continues_the_order_exactly(spark):
    p = order.permutation(spark.range(1000).withColumnRenamed("id", "k"), "k", 42, 3)
    whole = [r.k for r in p.orderBy("pos").collect()]
    tail = [r.k for r in order.resume(p, 7, 64).orderBy("pos").collect()]
    assert sorted(whole) == list(range(1000)) and whole[7 * 64 :] == tail
    assert whole != [r.k for r in order.permutation(spark.range(1000).withColumnRenamed("id", "k"), "k", 42, 4).orderBy("pos").collect()]


def test_positions_of_numbers_with_ties_negatives_and_none(spark):
    df = spark.createDataFrame([(5, 1), (-3, 2), (5, 0), (10**12, 9)], "a long, b long")
    assert [(r.a, r.b) for r in order.by_number(df, "a", F.col("b")).orderBy("pos").collect()] == [(-3, 2), (5, 0), (5, 1), (10**12, 9)]
    assert order.by_number(df.limit(0), "a").count() == 0


def test_ranks_share_equally(spark):
    p = order.by_number(spark.range(10), "id")
    for n in (3, 4, 25):
        sizes = {r["rank"]: r["count"] for r in order.rank_rows(p, n, 10).groupBy("rank").count().collect()}
        assert set(sizes) == set(range(n)) and len(set(sizes.values())) == 1
    assert order.rank_rows(p, 4, 10, drop_last=True).count() == 8


def test_round_robin_counts(spark):
    assert blend.wrr_cycle({"a": 0.75, "b": 0.25}) == ["a", "b"]
    c = blend.wrr_cycle({"a": 2.5, "b": 1})
    assert c.count("a") == 3 and c.count("b") == 1 and c[0] == "a"
    for bad in ({}, {"a": 0}, {"a": -1}):
        with pytest.raises(ValueError):
            blend.wrr_cycle(bad)
    with pytest.raises(ValueError):
        blend.draw(F.lit(0.5), [1.0], fallback=3)


def test_schedule_points():
    assert blend.resolve_points([(0.5, 1.0), (0, 0.0), (500, 9.0), (0.0005, 3.0)], 1000) == [(0, 0.0), (500, 1.0)]
    with pytest.raises(ValueError):
        blend.resolve_points([], 10)


@pytest.mark.parametrize("flush", [True, False])
def test_packing_equals_the_sequential_rule(spark, flush):
    rng = np.random.default_rng(0)
    docs = [(int(p), rng.integers(2, 99, rng.integers(0, 40)).tolist()) for p in rng.permutation(3000)]
    flat = [x for _, ids in sorted(docs) if ids for x in [*ids, 1]]
    want = [flat[i : i + 16] for i in range(0, len(flat), 16)]
    want = [w + [1] * (16 - len(w)) for w in want] if flush else [w for w in want if len(w) == 16]
    got = [list(r.input_ids) for r in text.pack(spark.createDataFrame(docs, "pos long, ids array<int>"), 16, 1, flush).orderBy("chunk").collect()]
    assert got == want


def test_casts_wrap_null_or_raise(spark):
    df = spark.createDataFrame([(300,), (-200,), (None,), (7,)], "x long")
    assert [r[0] for r in df.select(cast.to(F.col("x"), "int8")).collect()] == [44, 56, None, 7]
    assert [r[0] for r in df.select(cast.to(F.col("x"), "uint8", "null")).collect()] == [None, None, None, 7]
    with pytest.raises(Exception, match="out of range"):
        df.select(cast.to(F.col("x"), "int8", "error")).collect()
    with pytest.raises(ValueError):
        cast.to(F.col("x"), "int128")


def test_half_grids(spark):
    x = [0.1, 65519.0, 1e30, -2.5, float("nan"), None, 1.00390625]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(cast.to(F.col("x"), "float16").alias("h"), cast.to(F.col("x"), "bfloat16").alias("b")).collect()
    assert rows[0].h == float(np.float16(0.1)) and rows[2].h == float("inf") and rows[3].b == -2.5 and rows[5].h is None and rows[5].b is None
    assert rows[6].b == 1.0 and rows[0].b == 0.10009765625


def test_nested_validity(spark):
    df = spark.createDataFrame([(1, (1.0, [0.5, 2.0])), (2, (float("nan"), [0.0])), (3, (1.0, [float("inf")])), (4, None)], "id int, s struct<a:double,b:array<double>>")
    assert [r.id for r in df.where(quality.invalid(df)).orderBy("id").collect()] == [2, 3]


def test_windows_clamp_and_flag(spark):
    df = episode.frames(spark.createDataFrame([(1, i, float(i)) for i in range(4)], "ep int, t int, value double"), "ep", "t")
    r = episode.delta_window(df, "ep", "value", [-2, 0, 1]).orderBy("frame").collect()
    assert [x.value_window for x in r] == [[0, 0, 1], [0, 1, 2], [0, 2, 3], [1, 3, 3]]
    assert [x.value_is_pad for x in r] == [[True, False, False], [True, False, False], [False] * 3, [False, False, True]]
    assert episode.delta_indices([0.05, 0.15, 0.25], 10) == [0, 2, 2]


def test_shards_write_scan_and_cache(spark, tmp_path):
    path = str(tmp_path / "shards")
    catalog.write_shards(spark.createDataFrame([(f"row {i}" if i % 10 else "  ",) for i in range(100)], "text string").coalesce(1), path, rows=25)
    (tmp_path / "shards" / "broken.parquet").write_bytes(b"no parquet")
    df = catalog.scan(spark, path, ["text"])
    assert df.count() == 90 and [r.rows for r in catalog.catalog(catalog.scan(spark, path)).orderBy("file").collect()] == [25, 25, 25, 15]
    with pytest.raises(catalog.MissingData):
        catalog.scan(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        catalog.evictable(df, "text", "lifo")
    key = catalog.cache_key("a", 3, {"x": 1})
    assert key == catalog.cache_key("a", 3, {"x": 1}) != catalog.cache_key("a", 3, {"x": 2})
    root = str(tmp_path / "cache")
    assert catalog.cached(df, root, "t", {"v": 1}).count() == catalog.cached(df, root, "t", {"v": 1}).count() == 90


def test_growing_directory_is_read_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.range(5).write.parquet(src)
    for _ in range(2):
        growing.drain(growing.stream(spark, src, spark.range(1).schema), str(tmp_path / "ck"), lambda df, _: seen.append(df.count()))
        spark.range(5, 8).write.mode("append").parquet(src)
    assert sum(seen) == 8


def test_admission_and_failures(spark):
    old, new = spark.range(3).withColumnRenamed("id", "k"), spark.range(12).withColumnRenamed("id", "k")
    train = lambda c: F.pmod(c, F.lit(10)) != 9
    assert {r.k for r in growing.admit(old, new, "k", train).collect()} == set(range(12)) - {9}
    assert growing.admit(old, new.limit(0), "k", train).count() == 3 and growing.admit(old, new, "k", train, min_new=50).count() == 3
    log = spark.createDataFrame([(i, i not in (3, 4, 5)) for i in range(10)], "i int, ok boolean")
    assert growing.failure_abort(log, "i", "ok", 2) and not growing.failure_abort(log, "i", "ok", 3)
    state = growing.LoaderState(1, 2, 3, ["a"])
    assert growing.LoaderState.loads(state.dumps()) == state
