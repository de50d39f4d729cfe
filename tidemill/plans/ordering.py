"""Sampling, ordering, limits, partitioning, resumption."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import key, uniform
from ..operators import order
from .registry import query, t

PERM = "(select doc_id, row_number() over (order by md5('42:{e}:' || doc_id), doc_id) - 1 as pos from documents)"
P0, N = PERM.format(e=0), "(select count(*) from documents)"


def perm(spark, d, epoch=0):
    return order.permutation(t(spark, d, "documents").select("doc_id"), "doc_id", 42, epoch)


@query(f"select doc_id, pos from {P0}")
def epoch_permutation(spark, d):
    return perm(spark, d)


@query(f"select doc_id, pos from {PERM.format(e=1)}")
def epoch_permutation_next(spark, d):
    return perm(spark, d, 1)


@query("select doc_id, row_number() over (order by doc_id) - 1 as pos from documents")
def sequential_order(spark, d):
    return order.by_number(t(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"select doc_id, pos, cast(pos % 4 as integer) as rank, pos // 4 as step from (select * from {P0} union all select doc_id, pos + {N} from {P0} where pos < (4 - {N} % 4) % 4)")
def rank_partition_pad(spark, d):
    p = perm(spark, d)
    return order.rank_rows(p, 4, p.count())


@query(f"select doc_id, pos, cast(pos % 4 as integer) as rank, pos // 4 as step from {P0} where pos < {N} // 4 * 4")
def rank_partition_drop(spark, d):
    p = perm(spark, d)
    return order.rank_rows(p, 4, p.count(), drop_last=True)


@query(f"select cast(pos % 4 as integer) as rank, count(*) as n, min(pos) as first_pos from {P0} group by 1")
def rank_partition(spark, d):
    return perm(spark, d).groupBy(F.pmod("pos", F.lit(4)).cast("int").alias("rank")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(f"select doc_id, pos, pos // 32 as batch_id from {P0}")
def batch_assign(spark, d):
    return order.batches(perm(spark, d), 32)


@query(f"select doc_id, pos, pos // 32 as batch_id from {P0} where pos < {N} // 32 * 32")
def batch_drop_last(spark, d):
    p = perm(spark, d)
    return order.batches(p, 32, p.count())


@query(f"select doc_id, pos from {P0} where pos >= 320")
def resume_tail(spark, d):
    return order.resume(perm(spark, d), 10, 32)


@query(f"select doc_id, pos, cast((1000 * 32) // {N} as integer) as logical_epoch from {P0} where pos >= (1000 * 32) % {N}")
def resume_overflow(spark, d):
    p = perm(spark, d)
    return order.resume(p, 1000, 32, p.count())


@query("select doc_id, row_number() over (order by doc_id) - 1 as pos, cast((row_number() over (order by doc_id) - 1) % 4 as integer) as worker from documents")
def worker_stripe(spark, d):
    return order.by_number(t(spark, d, "documents").select("doc_id"), "doc_id").withColumn("worker", F.pmod("pos", F.lit(4)).cast("int"))


@query("select source, cast(pos % 3 as integer) as worker, pos from (select source, row_number() over (order by md5('42:0:' || source), source) - 1 as pos from (select distinct source from documents))")
def shard_partition(spark, d):
    shards = t(spark, d, "documents").select("source").distinct()
    return order.permutation(shards, "source").withColumn("worker", F.pmod("pos", F.lit(3)).cast("int"))


POOL = """(select doc_id, source, row_number() over (partition by source order by md5('42:0:' || doc_id), doc_id) - 1 as row_pos from documents)"""


@query(f"select s.worker, p.source, p.doc_id, p.row_pos, s.pos // 9 as pool_round from {POOL} p join (select source, pos, cast(pos % 3 as integer) as worker from (select source, row_number() over (order by md5('42:0:' || source), source) - 1 as pos from (select distinct source from documents))) s using (source)")
def pool_epoch_multiset(spark, d):
    """A worker reads its shards in pools of three; within a shard rows go in seeded order; each row once."""
    docs = t(spark, d, "documents").select("doc_id", "source")
    shards = order.permutation(docs.select("source").distinct(), "source").select("source", F.pmod("pos", F.lit(3)).cast("int").alias("worker"), F.floor(F.col("pos") / 9).alias("pool_round"))
    docs = docs.withColumn("digest", key(42, 0, F.col("doc_id")))
    rows = order.numbered_in(docs, ["source"], F.substring("digest", 1, 3), [F.col("digest"), F.col("doc_id")], "row_pos")
    return rows.join(shards, "source").select("worker", "source", "doc_id", "row_pos", "pool_round")


@query("with o as (select doc_id, text, row_number() over (order by doc_id) - 1 as pos from documents), f as (select min(pos) as stop from o where regexp_matches(text, '\\S') and pos + 1 >= 500) select doc_id, pos from o, f where pos <= coalesce(stop, pos) and regexp_matches(text, '\\S')")
def limit_docs(spark, d):
    """The first 500 documents of a stream: the check is skipped on blank ones, so one more may come."""
    o = order.by_number(t(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").rlike("\\S"), F.lit(False)).alias("full")), "doc_id")
    stop = o.where("full and pos + 1 >= 500").agg(F.min("pos").alias("stop"))
    return o.crossJoin(F.broadcast(stop)).where("full and pos <= coalesce(stop, pos)").select("doc_id", "pos")


@query("select doc_id from documents where doc_id % 10 <> 9")
def split_train(spark, d):
    return t(spark, d, "documents").where(F.pmod("doc_id", F.lit(10)) != 9).select("doc_id")


@query("select doc_id from documents where doc_id % 10 = 9")
def split_val(spark, d):
    return t(spark, d, "documents").where(F.pmod("doc_id", F.lit(10)) == 9).select("doc_id")


RING = "(select event_id, user_id, row_number() over (order by ts, event_id) - 1 as seq from events)"


def puts(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return order.by_number(e, "us", F.col("event_id"), name="seq")


@query(f"select event_id, seq, cast(seq % 256 as integer) as slot from {RING} where seq >= (select count(*) from events) - 256")
def ring_contents(spark, d):
    """What a ring of 256 slots holds after all puts."""
    p = puts(spark, d)
    return p.where(F.col("seq") >= p.count() - 256).select("event_id", "seq", F.pmod("seq", F.lit(256)).cast("int").alias("slot"))


@query(f"select a.event_id, a.seq, b.event_id as evicted from {RING} a join {RING} b on b.seq = a.seq - 256")
def ring_evicted(spark, d):
    p = puts(spark, d)
    return p.alias("a").join(p.select((F.col("seq") + 256).alias("seq"), F.col("event_id").alias("evicted")), "seq").select("event_id", "seq", "evicted")


U = "(cast('0x' || substr(md5({k}), 1, 13) as bigint) / 4503599627370496.0)"


@query(f"with r as (select event_id, seq % 256 as slot from {RING} where seq >= (select count(*) from events) - 256), u as (select x.range as draw, cast(floor({U.format(k=chr(39) + '42:0:' + chr(39) + ' || x.range')} * 256) as bigint) as slot from range(1000) x) select draw, slot, event_id from u join r using (slot)")
def ring_sample(spark, d):
    """1000 draws from the ring."""
    ring = ring_contents(spark, d).select(F.col("slot").cast("long").alias("slot"), "event_id")
    draws = spark.range(1000).select(F.col("id").alias("draw"), F.floor(uniform(key(42, 0, F.col("id"))) * 256).alias("slot"))
    return draws.join(F.broadcast(ring), "slot").select("draw", "slot", "event_id")  # 256 rows


@query(f"select user_id, n, cast(floor({U.format(k=chr(39) + '42:0:' + chr(39) + ' || user_id')} * n) as bigint) as frame from (select user_id, count(*) as n from events group by 1)")
def sample_frames(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("frame", F.floor(uniform(key(42, 0, F.col("user_id"))) * F.col("n")))


@query("select user_id, e.range as epoch, row_number() over (partition by e.range order by md5('42:' || e.range || ':' || user_id), user_id) - 1 as pos from (select distinct user_id from events), range(3) e")
def endless_epochs(spark, d):
    users = t(spark, d, "events").select("user_id").distinct().crossJoin(spark.range(3).withColumnRenamed("id", "epoch"))
    users = users.withColumn("digest", key(42, F.col("epoch"), F.col("user_id")))
    return order.numbered_in(users, ["epoch"], F.substring("digest", 1, 3), [F.col("digest"), F.col("user_id")]).select("user_id", "epoch", "pos")


@query(f"select seq, case when (event_id % 2) = 0 then 1 else -1 end as delta, cast(sum(case when (event_id % 2) = 0 then 1 else -1 end) over (order by seq) as bigint) as balance from {RING}")
def gate_balance(spark, d):
    """Produced minus consumed along a log: prefix sums in two phases, by bucket and within."""
    width = max(4096, -(-t(spark, d, "events").count() // order.BUCKETS))
    p = puts(spark, d).select("seq", F.when(F.pmod("event_id", F.lit(2)) == 0, 1).otherwise(-1).alias("delta"), F.floor(F.col("seq") / width).alias("b"))
    sums = p.groupBy("b").agg(F.sum("delta").alias("s"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("o"))
    inside = F.sum("delta").over(Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return p.join(offsets, "b").select("seq", "delta", (F.col("o") + inside).alias("balance"))
