"""Policies, contracts, views, metadata, media and loaders: errors and states that SQL doesn't cover."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from tidemill.operators import adapters, blend, cast, contract, loader, media, order, policy, text
from tidemill.sources import catalog, episodes, shared, view
from tidemill.streaming.growing import LoaderState


def test_budgets_raise_at_the_right_row(spark):
    # one failure, a success, then three in a row; the epoch changes between the second and the third
    log = spark.createDataFrame([(1, i, i not in (2, 5, 6, 7), i // 7) for i in range(10)], "part int, i int, ok boolean, epoch int")
    stop = lambda b, epoch=None: [(r.stop, r.why) for r in policy.stops(log, ["part"], "i", F.col("ok"), b, epoch).collect()]
    assert stop(policy.Budgets(3, None, None)) == [(7, "consecutive")]
    assert stop(policy.Budgets(3, None, None), "epoch") == []  # a new epoch resets the count
    assert stop(policy.Budgets(None, 2, None)) == [(6, "epoch")] and stop(policy.Budgets(None, None, 3)) == [(7, "total")]
    assert stop(policy.Budgets(1, None, None)) == [(2, "consecutive")] and stop(policy.Budgets(None, None, None)) == []


def test_skipping_has_a_limit(spark):
    rows = spark.createDataFrame([(1, i, i == 0) for i in range(5)] + [(2, 0, False)], "part int, i int, ok boolean")
    got = {(r.part, r.i): (r.next_pos, r.tries) for r in policy.skipped_to(rows, ["part"], "i", F.col("ok"), 3).collect()}
    assert got == {(1, 0): (0, 1), (1, 1): (None, 3), (1, 2): (None, 3), (1, 3): (0, 3), (1, 4): (0, 2), (2, 0): (None, 1)}


def test_rates_and_retries():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        now[0] += x

    bucket = policy.TokenBucket(2.0, 3.0, lambda: now[0], sleep)
    assert [round(bucket.acquire(), 3) for _ in range(5)] == [0, 0, 0, 0.5, 0.5]
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("429")
        return "done"

    slept.clear()
    assert policy.retried(call, policy.TokenBucket(100, 100, lambda: now[0], sleep), lambda e: "429" in str(e)) == "done" and slept == [30.0, 60.0]
    with pytest.raises(OSError):
        policy.retried(lambda: (_ for _ in ()).throw(OSError("404")), bucket, lambda e: "429" in str(e))
    with pytest.raises(ValueError):
        policy.TokenBucket(0)


def test_contracts(spark):
    rows = spark.createDataFrame([(1, [[1, 2], [3, 4]], "a", ["a"]), (2, [[1], [3, 4]], "b", ["a", "z"]), (3, None, None, [])], "id long, x array<array<int>>, tag string, tags array<string>")
    c = contract.Contract((contract.Field("id", "int64"), contract.Field("x", "int32", (2, 2)), contract.Field("gone", required=False)), "tag", ("a", "b"))
    assert c.faults(rows) == []
    assert {(r.id, r.field, r.rule) for r in c.violations(rows, ["id"]).collect()} == {(2, "x", "length"), (3, "x", "null"), (3, "tag", "source")}
    many = contract.Contract((), "tags", ("a",))
    assert {r.id for r in many.violations(rows, ["id"]).collect()} == {2, 3}
    wrong = contract.Contract((contract.Field("x", "int64", (2, 2)), contract.Field("y"), contract.Field("id", "int64", (1,))), "none")
    assert wrong.faults(rows) == ["x: int, not int64", "y: missing", "id: rank 0, not 1", "none: missing"]
    c.probe(rows.where("id = 1"))
    for bad in (rows, rows.drop("x")):
        with pytest.raises(contract.ContractError):
            c.probe(bad)
    batched = rows.withColumn("batch", F.col("id") - 1)
    assert c.checked(batched.where("id < 3"), "batch").count() == 2
    with pytest.raises(Exception, match="contract: x"):
        c.checked(batched, "batch", 2).collect()
    with pytest.raises(ValueError):
        contract.Field("x", "int128")


def test_cast_rules(spark):
    rules = cast.Rules()
    rules.add("s.a", "int8"), rules.add("s.xs[1]", "float16")
    assert rules.remove("none") is False and rules.summary()["by_dtype"] == {"int8": 1, "float16": 1}
    row = rules.apply(spark.createDataFrame([((300, [0.1, 0.1, None]),), ((1, None),)], "s struct<a:long,xs:array<double>>")).collect()
    assert row[0].s.a == 44 and row[0].s.xs[0] == 0.1 and row[0].s.xs[1] == 0.0999755859375 and row[0].s.xs[2] is None and row[1].s.xs is None
    for i in range(1200):
        rules.failed("s.a", str(i))
    assert len(rules.history) == 1000 and rules.summary()["failures"] == {"s.a": 1200} and rules.summary()["last"][-1] == ("s.a", "1199")
    with pytest.raises(ValueError):
        rules.add("s.a", "int128")
    with pytest.warns(UserWarning):
        assert cast.lossy("float64", "float16")
    assert not cast.lossy("float16", "float32")


def test_half_grids_round_once(spark):
    import numpy as np

    # just above a tie of half precision: single precision would make it the tie
    x = [1 + 2**-11 + 2**-40, 2**-24, 2**-25, 3e-8, 65519.99, 65520.0, -70000.0, 2**-14, 0.0, 5.96e-8 * 1.5]
    got = [r.h for r in spark.createDataFrame([(v,) for v in x], "x double").select(cast.to(F.col("x"), "float16").alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float64(v).astype(np.float16)) for v in x]


def test_views_freeze_pin_and_remove_later(spark):
    s = view.ViewState()
    s.schedule("a", "b", "a")
    s.freeze(["b", "c"])
    assert s.take_scheduled() == [] and view.ViewState.loads(s.dumps()) == s
    s.unfreeze()
    assert s.take_scheduled() == ["a", "b"] and s.take_scheduled() == [] and s.pinned is None
    names = lambda df: {r.k for r in df.collect()}
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    visible, removed = view.refreshed(df("a", "b"), df("b", "c"), df("b", "x"), "k")
    assert names(visible) == {"a", "c"} and names(removed) == {"b"}
    visible, removed = view.refreshed(df("a", "b"), df("b", "c"), df("b"), "k", True, df("b", "z"))
    assert names(visible) == {"b"} and names(removed) == set() and names(view.missing_pins(df("b", "z"), df("b"), "k")) == {"z"}


def test_episode_metadata(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta").mkdir(parents=True)
    with pytest.raises(catalog.MissingData):
        episodes.info(spark, str(root))
    (root / "meta/info.json").write_text(json.dumps({"fps": 30, "total_episodes": 3}, indent=1))
    assert episodes.info(spark, str(root))["fps"] == 30 and episodes.tasks(spark, str(root)).count() == 0
    with pytest.raises(catalog.MissingData):
        episodes.episodes(spark, str(root))
    (root / "meta/episodes.jsonl").write_text("\n".join(json.dumps({"episode_index": i, "length": 10 + i, "tasks": ["go"]}) for i in (7, 2, 4)))
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "go"}\n')
    assert [r.task for r in episodes.tasks(spark, str(root)).collect()] == ["go"]
    e = episodes.episodes(spark, str(root))
    ranges = episodes.contiguous(episodes.positional(e, "episode_index").join(e, "episode_index"), "position", "length")
    assert [(r.episode_index, r["first"], r.past) for r in ranges.orderBy("position").collect()] == [(2, 0, 12), (4, 12, 26), (7, 26, 43)]
    episodes.check_rows(ranges, 43)
    with pytest.raises(ValueError):
        episodes.check_rows(ranges, 44)
    for i in (2, 7):
        (root / "data/chunk-000").mkdir(parents=True, exist_ok=True)
        spark.range(i).coalesce(1).toPandas().to_parquet(root / f"data/chunk-000/episode_{i:06d}.parquet")
    listing = episodes.files(spark, str(root))
    media_ = spark.createDataFrame([(2, "top"), (2, "side"), (7, "top"), (4, "top"), (4, "side")], "episode_index long, key string")
    assert {r.episode_index for r in episodes.ready(listing, media_, ["top", "side"]).collect()} == {2}
    assert {r.episode_index for r in episodes.ready(listing, media_, []).collect()} == {2, 7}


def test_frames_and_decoders(spark):
    r = media.Compose((media.Resize(2, 2), media.Resize(4, 4)))
    assert r.shape((8, 6)) == (4, 4)
    got = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "x array<double>").select(media.Resize(2, 4).apply(F.col("x"), (2, 2)).alias("y")).first().y
    assert got == [0.0, 0.25, 0.75, 1.0, 2.0, 2.25, 2.75, 3.0]
    with pytest.raises(ValueError):
        media.Compose(())

    def decoder(b):
        return ([len(b)], bytes(b)) if b != b"bad" else 1 / 0

    files = spark.createDataFrame([("a", b"123"), ("b", b"bad"), ("c", b"4")], "path string, content binary").coalesce(1)
    rows = {x.path: x for x in media.decoded(files, decoder).collect()}
    assert rows["a"].shape == [3] and bytes(rows["c"].pixels) == b"4" and rows["b"].error.startswith("ZeroDivisionError") and rows["b"].pixels is None
    with pytest.raises(Exception, match="can't be decoded"):
        media.decoded(spark.createDataFrame([("b", b"bad")] * 4, "path string, content binary").coalesce(1), decoder, 2).collect()


def test_loader(spark):
    assert [loader.workers(-1, c) for c in (1, 12, 17, 41, 128)] == [2, 2, 4, 6, 16] and loader.workers(0) == 0
    for bad in (lambda: loader.workers(-2), lambda: loader.composed(), lambda: loader.split_rule(1.0), lambda: loader.loader(spark.range(3), "id", 0)):
        with pytest.raises(ValueError):
            bad()
    assert [loader.split_rule(x) for x in (0.9, 0.8, 0.75, 0.5, 0.7)] == [(10, 9), (10, 8), (4, 3), (10, 5), (10, 7)]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert loader.split_rule(0.33) == (10, 9) and w
    df = spark.range(103)
    whole = loader.loader(df, "id", 8, 7, 3, 1, 4).orderBy("step").collect()
    rest = loader.loader(df, "id", 8, rank=1, world=4, state=LoaderState(7, 3, 2)).orderBy("step").collect()
    assert len(whole) == 26 and whole[16:] == rest
    assert {r["count"] for r in loader.loader(df, "id", 8, world=4, drop_last=True).groupBy("batch_id").count().collect()} == {8}

    def kernel(x):
        return None if x == "none" else ([1, 2], [True]) if x == "bad" else ([len(x)], [True])

    docs = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "none"), (5, "bad"), (6, "x")], "id int, text string").coalesce(1)
    assert [(r.id, r.tokens, r.mask) for r in loader.kernel_tokens(docs, "text", kernel).orderBy("id").collect()] == [(1, [3], [True]), (6, [1], [True])]
    with pytest.raises(Exception, match="failed on 3 texts"):
        loader.kernel_tokens(spark.createDataFrame([(1, "bad")] * 5, "id int, text string").coalesce(1), "text", kernel, 3).collect()


def test_token_rows_and_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "k long, tokens array<string>")
    for most in (100, 0):  # by a broadcast, and by a join
        assert {r.k: r.ids for r in text.token_ids(docs, "k", broadcast_rows=most).collect()} == {1: [3, 2, 3], 2: [], 3: [4]}
    numbered = order.by_number(docs.select("k"), "k")
    assert [r.k for r in catalog.token_rows(numbered, [2]).collect()] == [3]
    with pytest.raises(IndexError):
        catalog.token_rows(numbered, [0, 3])
    with pytest.raises(catalog.MissingData):
        catalog.token_scan(spark, str(tmp_path), "val")
    with pytest.raises(IndexError):
        text.sampled(spark.range(0).withColumnRenamed("id", "slot"), "slot", 5, F.md5(F.lit("x")))


def test_pools_and_buffers_keep_every_row(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("shard"))
    got = order.pooled(df, "shard", "id", 2).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(500)) and {r.id for r in got} == set(range(500))
    assert [len({r.shard for r in got if r.pool_id == k}) for k in range(4)] == [2, 2, 2, 1] and [r.pool_id for r in got] == sorted(r.pool_id for r in got)
    out = order.buffered(order.by_number(df, "id"), 64).collect()
    assert sorted(r.out for r in out) == list(range(500)) and all(abs(r.out - r.pos) < 64 for r in out) and any(r.out != r.pos for r in out)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf())  # noqa: N815
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_adapters_keep_what_is_there(spark):
    df = spark.createDataFrame([(1, [5, 0], [1, 0], "x")], "k int, input_ids array<int>, loss_mask array<int>, extra string")
    r = adapters.adapt(df, "pretrain", ["k"]).first()
    assert r.asDict() == {"k": 1, "input_ids": [5, 0], "loss_mask": [True, False], "labels": [5, 0], "source_tag": "pretrain_pad"}
    assert adapters.adapt(df.drop("loss_mask").withColumn("labels", F.array(F.lit(9))), "pretrain").first().asDict() == {"input_ids": [5, 0], "labels": [9], "loss_mask": [True, False], "source_tag": "pretrain_pad"}
    for bad in (lambda: adapters.adapt(df, "none"), lambda: adapters.adapt(df.drop("input_ids"), "val")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        adapters.adapt(df.withColumn("loss_mask", F.lit(1)), "val")


def test_positions_with_far_outliers_and_bad_schedules(spark):
    df = spark.range(3000).union(spark.createDataFrame([(10**17,), (-(10**17),)], "id long"))
    got = [r.id for r in order.by_number(df, "id").orderBy("pos").collect()]
    assert got == [-(10**17), *range(3000), 10**17]
    for bad in ([(True, 1.0)], [(1.5, 1.0)], [(-1, 1.0)]):
        with pytest.raises(ValueError):
            blend.resolve_points(bad, 100)
