"""Shards, retention, caches, prefetching, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import key
from ..operators import order
from ..sources import catalog as K
from ..sources.shared import work_dir
from .registry import query, t

SH = "(select source as file, count(*) as rows, cast(sum(n_chars) as bigint) as bytes from documents group by 1)"


def shards(spark, d):
    return t(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("bytes"))


@query("select text, row_number() over (order by doc_id) - 1 as pos from documents")
def scan_text(spark, d):
    return order.by_number(K.scan(spark, f"{d}/documents.parquet", ["doc_id", "text"]), "doc_id").select("text", "pos")


@query(f"select file, rows, bytes, cast(coalesce(sum(rows) over (order by file rows between unbounded preceding and 1 preceding), 0) as bigint) as off from {SH}")
def shard_catalog(spark, d):
    return K.offsets(shards(spark, d), "file", "rows")


@query("select count(*) as rows from documents")
def file_catalog(spark, d):
    """The catalogue of the table's files: their rows add up."""
    return K.catalog(K.scan(spark, f"{d}/documents.parquet")).agg(F.sum("rows").alias("rows"))


@query(f"with c as (select file, rows, coalesce(sum(rows) over (order by file rows between unbounded preceding and 1 preceding), 0)::bigint as off from {SH}), n as (select sum(rows)::bigint as total from {SH}) select e.event_id as pos, c.file, cast(e.event_id % n.total - c.off as bigint) as local from events e, n join c on e.event_id % n.total >= c.off and e.event_id % n.total < c.off + c.rows")
def shard_locate(spark, d):
    return K.locate(t(spark, d, "events").select(F.col("event_id").alias("pos")), K.offsets(shards(spark, d), "file", "rows")).select("pos", "file", "local")


@query("select doc_id, pos // 100 as shard, printf('shard_%06d.parquet', pos // 100) as file from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents where regexp_matches(text, '\\S'))")
def shard_assign(spark, d):
    o = order.by_number(t(spark, d, "documents").where(F.col("text").rlike("\\S")).select("doc_id"), "doc_id")
    return o.withColumn("shard", F.floor(F.col("pos") / 100)).select("doc_id", "shard", F.format_string("shard_%06d.parquet", "shard").alias("file"))


@query("with o as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) select s.k as stream, doc_id, (pos + n - s.k * (n // 2)) % n as seq from o, (values (0), (1)) s(k)")
def multi_offset(spark, d):
    """Two streams over all documents, that begin at different offsets and go round."""
    o = order.by_number(t(spark, d, "documents").select("doc_id"), "doc_id")
    n = t(spark, d, "documents").count()
    return o.withColumn("stream", F.explode(F.array(F.lit(0), F.lit(1)))).select("stream", "doc_id", F.pmod(F.col("pos") + n - F.col("stream") * (n // 2), F.lit(n)).alias("seq"))


_RN = f"(select file, rows, row_number() over (order by file) as rn, count(*) over () as n from {SH})"


@query(f"select 'fifo' as strategy, min(file) as file from {SH} union all (select 'stochastic_oldest', file from {_RN} where rn <= greatest(1, n // 2) order by md5('42:0:' || file) limit 1) union all (select 'random', file from {SH} order by md5('42:0:' || file) limit 1)")
def evict_candidates(spark, d):
    s, digest = shards(spark, d), key(42, 0, F.col("file"))
    out = [K.evictable(s, "file", x, digest).select(F.lit(x).alias("strategy"), "file") for x in ("fifo", "stochastic_oldest", "random")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"select file, cast(kept as bigint) as kept_bytes from (select file, sum(bytes) over (order by file desc) as kept, (select sum(bytes) // 2 from {SH}) as budget from {SH}) where kept <= budget")
def retention_keep(spark, d):
    s = shards(spark, d)
    return K.retained(s, "file", "bytes", s.agg(F.sum("bytes")).first()[0] // 2).select("file", "kept_bytes")


@query("select d.source, coalesce(bool_and(l.quality = 1), true) as ready from (select distinct source from documents) d left join (select source, quality from documents join labels using (doc_id)) l using (source) group by 1")
def companions_ready(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    ok = docs.join(t(spark, d, "labels"), "doc_id").groupBy("source").agg(F.bool_and(F.col("quality") == 1).alias("ready"))
    return docs.select("source").distinct().join(ok, "source", "left").select("source", F.coalesce("ready", F.lit(True)).alias("ready"))


@query("select event_type, user_id as key, max(event_id) as last_access from events group by 1, 2 qualify row_number() over (partition by event_type order by max(event_id) desc) <= 50")
def lru_resident(spark, d):
    """What an LRU store of 50 keys for each type holds after the log."""
    last = t(spark, d, "events").groupBy("event_type", F.col("user_id").alias("key")).agg(F.max("event_id").alias("last_access"))
    # each task keeps its own 50 of a type before they meet
    own = F.row_number().over(Window.partitionBy("event_type", "task").orderBy(F.desc("last_access")))
    few = last.withColumn("task", F.spark_partition_id()).withColumn("r", own).where("r <= 50").drop("r", "task")
    return few.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("last_access")))).where("r <= 50").drop("r")


@query("select doc_id, coalesce(l.quality, -1) as quality, l.doc_id is not null as hit from documents left join labels l using (doc_id)")
def direct_with_fallback(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return t(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("hit", F.lit(False)).alias("hit"))


@query("with k as (select doc_id, row_number() over (order by doc_id) - 1 as slot from labels), n as (select count(*) as n from labels) select e.event_id, k.doc_id from events e, n join k on k.slot = e.event_id % n.n")
def available_mod(spark, d):
    labels = t(spark, d, "labels")
    k = order.by_number(labels.select("doc_id"), "doc_id", name="slot")
    return t(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(max(1, labels.count()))).alias("slot")).join(k, "slot").select("event_id", "doc_id")


@query("select 0 as rank, doc_id from labels where toxic = 1 union all select 1, doc_id from documents")
def priority_order(spark, d):
    first = t(spark, d, "labels").where("toxic = 1").select(F.lit(0).alias("rank"), "doc_id")
    return first.unionByName(t(spark, d, "documents").select(F.lit(1).alias("rank"), "doc_id"))


@query("select count(*) as length, sha256('documents:' || count(*) || ':{\"lang\":\"en\"}') as cache_key from documents where lang = 'en'")
def cache_key(spark, d):
    n = t(spark, d, "documents").where("lang = 'en'").agg(F.count("*").alias("length"))
    spec = F.to_json(F.struct(F.lit("en").alias("lang")))
    return n.select("length", F.sha2(F.concat_ws(":", F.lit("documents"), F.col("length").cast("string"), spec), 256).alias("cache_key"))


@query("select user_id % 4 as grp, count(*) as puts, count(*) - least(count(*), 16) as evicted from events group by 1")
def stream_ring(spark, d):
    """Ring state of a stream: 16 slots for each of four groups, fed from the events table as a file stream."""
    from ..streaming.growing import drain, ring, stream

    work = work_dir(spark, "stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = t(spark, d, "events").schema
        puts = stream(spark, f"{d}/events.parquet*", schema).select((F.col("user_id") % 4).alias("grp"), F.col("event_id").alias("key"))
        drain(ring(puts, "grp", "key", "key", 16), f"{work}/state", lambda df, batch: df.write.mode("overwrite").parquet(f"{work}/out/batch={batch}"))  # a batch that is tried again replaces itself
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{work}/out").drop("batch").groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("puts"), F.count("evicted").alias("evicted"))


