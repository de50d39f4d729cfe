"""Time series, joins and episode listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episode as E
from .registry import query, t

FR = "(select event_id, user_id, event_type, value, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, count(*) over (partition by user_id) as n from events)"


def frames(spark, d):
    return E.frames(t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts"), "user_id", "ts", "event_id")


@query(f"select event_id, user_id, frame, n from {FR}")
def episode_scan(spark, d):
    return frames(spark, d).select("event_id", "user_id", "frame", "n")


@query("select user_id, count(*) as length from events group by 1")
def episode_lengths(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("length"))


@query("select distinct user_id, printf('data/chunk-%03d/episode_%06d.parquet', user_id // 1000, user_id) as path from events")
def episode_path(spark, d):
    return t(spark, d, "events").select("user_id").distinct().withColumn("path", E.episode_path(F.col("user_id")))


@query("select user_id, count(distinct event_type) as n_media from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)")
def ready_episodes(spark, d):
    """Episodes for which every media key is there."""
    e = t(spark, d, "events").select("user_id", "event_type").distinct()
    keys = e.agg(F.count_distinct("event_type").alias("k"))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_media")).crossJoin(F.broadcast(keys)).where("n_media = k").select("user_id", "n_media")  # one row


@query("select distinct cast(regexp_extract(printf('data/data/episode_%06d.parquet', user_id), 'episode_(\\d+)', 1) as bigint) as episode from events")
def scan_distinct_episodes(spark, d):
    paths = t(spark, d, "events").select(F.format_string("data/data/episode_%06d.parquet", "user_id").alias("p"))
    return paths.select(F.regexp_extract("p", r"episode_(\d+)", 1).cast("bigint").alias("episode")).distinct()


@query("select count(distinct user_id) as ready, max(user_id) as last_id, count(distinct user_id) >= 100 and max(user_id) >= 99 as complete from events")
def layout_complete(spark, d):
    return t(spark, d, "events").agg(F.count_distinct("user_id").alias("ready"), F.max("user_id").alias("last_id")).withColumn("complete", (F.col("ready") >= 100) & (F.col("last_id") >= 99))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def missing_episodes(spark, d):
    """Expected keys for which nothing is there."""
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"select user_id, frame, gap from (select user_id, frame, round(epoch(ts) - epoch(lag(ts) over (partition by user_id order by frame)), 6) as gap from {FR}) where abs(gap - 3600.0) > 1800.0")
def timestamp_sync(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return E.timestamp_faults(frames(spark, d), "user_id", s, 1 / 3600.0, 1800.0).select("user_id", "frame", F.round("gap", 6).alias("gap"))


TASKS = "(values ('click', 'press a button'), ('view', 'look at a page')) v(event_type, task)"


@query(f"select e.event_id, e.event_type, coalesce(v.task, '') as task from events e left join {TASKS} using (event_type)")
def task_lookup(spark, d):
    tasks = spark.createDataFrame([("click", "press a button"), ("view", "look at a page")], "event_type string, task string")
    return E.lookup(t(spark, d, "events").select("event_id", "event_type"), F.broadcast(tasks), "event_type", "task")  # a fixed handful


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 10)")
def pinned_shards(spark, d):
    pins = t(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(pins, "o_custkey", "left_semi")


@query("select doc_id from documents where doc_id % 10 = 3 and doc_id not in (select doc_id from labels where doc_id is not null)")
def pinned_missing(spark, d):
    """Pins that aren't there any more."""
    from ..sources.view import missing_pins

    pins = t(spark, d, "documents").where(F.pmod("doc_id", F.lit(10)) == 3).select("doc_id")
    return missing_pins(pins, t(spark, d, "labels"), "doc_id")


@query("select delta, cast(round_even(delta * 10, 0) as bigint) as idx from (values (-0.25::double), (-0.05::double), (0.0::double), (0.05::double), (0.15::double), (0.25::double)) v(delta)")
def delta_indices(spark, d):
    return spark.createDataFrame([(x,) for x in (-0.25, -0.05, 0.0, 0.05, 0.15, 0.25)], "delta double").withColumn("idx", F.bround(F.col("delta") * 10).cast("bigint"))


def _v(k):
    return f"case when frame + {k} < 0 then first_value(value) over w when frame + {k} >= n then last_value(value) over w else {f'lag(value, {-k}) over o' if k < 0 else f'lead(value, {k}) over o' if k else 'value'} end"


WIN = f"(select event_id, user_id, frame, {_v(-2)} as w0, {_v(0)} as w1, {_v(1)} as w2, frame - 2 < 0 as p0, false as p1, frame + 1 >= n as p2 from {FR} window o as (partition by user_id order by frame), w as (partition by user_id order by frame rows between unbounded preceding and unbounded following))"


def windowed(spark, d):
    got = E.delta_window(frames(spark, d), "user_id", "value", [-2, 0, 1])
    return got.select("event_id", "user_id", "frame", *[F.col("value_window")[i].alias(f"w{i}") for i in range(3)], *[F.col("value_is_pad")[i].alias(f"p{i}") for i in range(3)])


@query(f"select event_id, user_id, frame, w0, w1, w2 from {WIN}")
def delta_window(spark, d):
    return windowed(spark, d).select("event_id", "user_id", "frame", "w0", "w1", "w2")


@query(f"select event_id, p0, p1, p2 from {WIN}")
def delta_padding(spark, d):
    return windowed(spark, d).select("event_id", "p0", "p1", "p2")


@query("select event_id, cast(event_id % 256 as smallint) as raw, round(cast(event_id % 256 as double) / 255, 6) as scaled from events")
def scale_uint8(spark, d):
    raw = F.pmod("event_id", F.lit(256))
    return t(spark, d, "events").select("event_id", raw.cast("smallint").alias("raw"), F.round(raw.cast("double") / 255, 6).alias("scaled"))


@query(f"select user_id, array_to_string(list(event_id order by frame), ' ') as event_ids from {FR} group by 1")
def episode_row(spark, d):
    g = frames(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("frame", "event_id"))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda s: s["event_id"].cast("string")), " ").alias("event_ids"))


@query(f"select w.event_id, w.user_id, w.frame, e.event_type, w0, w1, w2, p0, p1, p2, coalesce(v.task, '') as task from {WIN} w join events e using (event_id) left join {TASKS} using (event_type)")
def assemble_sample(spark, d):
    got = E.delta_window(frames(spark, d), "user_id", "value", [-2, 0, 1])
    tasks = spark.createDataFrame([("click", "press a button"), ("view", "look at a page")], "event_type string, task string")
    got = E.lookup(got, F.broadcast(tasks), "event_type", "task")  # a fixed handful
    return got.select("event_id", "user_id", "frame", "event_type", *[F.col("value_window")[i].alias(f"w{i}") for i in range(3)], *[F.col("value_is_pad")[i].alias(f"p{i}") for i in range(3)], "task")


@query(f"select user_id, frame from {FR} where user_id % 10 = 9")
def val_pairs(spark, d):
    lengths = t(spark, d, "events").where(F.pmod("user_id", F.lit(10)) == 9).groupBy("user_id").agg(F.count("*").alias("n"))
    return lengths.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))


@query("select count(*) as frames, count(distinct user_id) as episodes from events where user_id % 10 <> 9")
def epoch_length(spark, d):
    return t(spark, d, "events").where(F.pmod("user_id", F.lit(10)) != 9).agg(F.count("*").alias("frames"), F.count_distinct("user_id").alias("episodes"))


@query("select distinct user_id from events where user_id % 10 <> 9 and (user_id % 10 = 9 or user_id % 25 = 0)")
def isolation_leaks(spark, d):
    """Episodes that a held-out split shares with the train split: here it took every 25th too."""
    e = t(spark, d, "events").select("user_id").distinct()
    held = e.where((F.pmod("user_id", F.lit(10)) == 9) | (F.pmod("user_id", F.lit(25)) == 0))
    return e.where(F.pmod("user_id", F.lit(10)) != 9).join(held, "user_id", "left_semi")


@query("select o_custkey from orders group by o_custkey having min(o_orderdate) >= (select quantile_disc(o_orderdate, 0.1) from orders) and o_custkey % 10 <> 9")
def admission_delta(spark, d):
    """Keys that the later of two snapshots adds, of the train split."""
    e = t(spark, d, "orders").select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    cut = e.agg(F.expr("percentile_disc(0.1) within group (order by us)").cast("long").alias("cut"))
    later = e.groupBy("o_custkey").agg(F.min("us").alias("first")).crossJoin(F.broadcast(cut))  # one row
    return later.where((F.col("first") >= F.col("cut")) & (F.pmod("o_custkey", F.lit(10)) != 9)).select("o_custkey")


@query("select 50 as min_episodes, greatest(50, cast(floor(0.1 * count(distinct user_id)) as bigint)) as gate from events")
def start_gate(spark, d):
    return t(spark, d, "events").agg(F.greatest(F.lit(50).cast("bigint"), F.floor(F.lit(0.1) * F.count_distinct("user_id"))).alias("gate")).select(F.lit(50).alias("min_episodes"), "gate")
