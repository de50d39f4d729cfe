"""Blending of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import key, uniform
from ..operators import blend, order
from .registry import query, t

LANGS = ["en", "de", "es", "fr"]
WEIGHTS = [0.5, 0.3, 0.2, 0.0]
U = "(cast('0x' || substr(md5('42:0:' || pos), 1, 13) as bigint) / 4503599627370496.0)"
ORD = "(select doc_id, lang, row_number() over (order by doc_id) - 1 as pos from documents)"


def ordered(spark, d):
    return order.by_number(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")


_CYCLE = blend.wrr_cycle({"en": 3.0, "de": 1.5, "es": 1.0})


_LEFT = "(select name, row_number() over (order by w - k desc, i) - 1 as place, count(*) over () as n from (select * from (values (0, 'en', 3.0), (1, 'de', 1.5), (2, 'es', 1.0)) v(i, name, w), (select unnest(range(3)) as k) where k < w))"


@query(f"select doc_id, pos, name as pick from {ORD} join {_LEFT} on place = pos % n")
def wrr_dispatch(spark, d):
    return ordered(spark, d).select("doc_id", "pos", blend.at_cycle(_CYCLE, F.col("pos")).alias("pick"))


_SMOOTH = blend.smooth_wrr_cycle({"en": 3, "de": 1})


@query(f"with recursive s as (select 0 as i, -1 as a, 1 as b, 'en' as pick union all select i + 1, a + 3 - case when a + 3 >= b + 1 then 4 else 0 end, b + 1 - case when a + 3 >= b + 1 then 0 else 4 end, case when a + 3 >= b + 1 then 'en' else 'de' end from s where i < 3) select doc_id, pos, pick from {ORD} join s on i = pos % 4")
def smooth_wrr_dispatch(spark, d):
    return ordered(spark, d).select("doc_id", "pos", blend.at_cycle(_SMOOTH, F.col("pos")).alias("pick"))


@query(f"with s as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from documents), q as (select pos, case when {U} * 1.0 < 0.5 then 0 when {U} * 1.0 < 0.8 then 1 else 2 end as source_idx from {ORD}), l as (select * from (values (0, 'en'), (1, 'de'), (2, 'es'), (3, 'fr')) v(source_idx, lang)) select q.pos, q.source_idx, s.doc_id from q join l using (source_idx) join s on s.lang = l.lang and s.i = q.pos % s.n")
def blend_draw(spark, d):
    """As many draws as there are documents; each takes row pos mod length of its source."""
    docs = t(spark, d, "documents").select("doc_id", "lang")
    index = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int") - 1
    rows = docs.select("doc_id", index.alias("source_idx"))
    counts = rows.groupBy("source_idx").agg(F.count("*").alias("n"))  # one row a source
    low = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    numbered = order.numbered(rows, F.concat_ws("-", F.lpad(F.col("source_idx").cast("string"), 3, "0"), F.lpad(F.floor((F.col("doc_id") - F.lit(low[0] or 0)) / F.lit(max(1, -(-((low[1] or 0) - (low[0] or 0) + 1) // 1000)))).cast("string"), 4, "0")), [F.col("doc_id")], "g")
    starts = counts.select("source_idx", "n", F.coalesce(F.sum("n").over(Window.orderBy("source_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = numbered.join(F.broadcast(starts), "source_idx").select("source_idx", (F.col("g") - F.col("start")).alias("i"), "doc_id")
    draws = ordered(spark, d).select("pos", blend.draw(uniform(key(42, 0, F.col("pos"))), WEIGHTS).alias("source_idx"))
    draws = draws.join(F.broadcast(counts), "source_idx").withColumn("i", F.pmod("pos", "n"))
    return draws.join(placed, ["source_idx", "i"]).select("pos", "source_idx", "doc_id")


@query(f"select pos, 2 as source_idx from {ORD}")
def blend_zero_fallback(spark, d):
    return ordered(spark, d).select("pos", blend.draw(uniform(key(42, 0, F.col("pos"))), [0.0, 0.0, 0.0], fallback=2).alias("source_idx"))


@query(f"select pos, case when {U} * 1.0 < 0.25 then 1 else 2 end as source_idx from {ORD}")
def blend_negative_clamp(spark, d):
    return ordered(spark, d).select("pos", blend.draw(uniform(key(42, 0, F.col("pos"))), [-1.0, 0.25, 0.75]).alias("source_idx"))


@query(f"select pos, case when {U} * 1.0 < 0.7 then 0 else 1 end as source_idx from {ORD}")
def blend_two_way(spark, d):
    r = min(1.0, max(0.0, 0.3))
    return ordered(spark, d).select("pos", blend.draw(uniform(key(42, 0, F.col("pos"))), [1 - r, r]).alias("source_idx"))


@query(f"with c as (select lang, count(*) * case lang when 'en' then 0.5 when 'de' then 2.0 else 1.0 end as mass from documents group by 1), b as (select lang, sum(mass) over (order by lang) - mass as lo, sum(mass) over (order by lang) as hi, sum(mass) over () as total from c) select pos, b.lang from {ORD} o join b on {U} * b.total >= b.lo and {U} * b.total < b.hi")
def weighted_concat(spark, d):
    """With replacement, every row carries its source's weight: a source's share is weight x rows."""
    o = ordered(spark, d)
    mass = t(spark, d, "documents").groupBy("lang").agg((F.count("*") * F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 2.0).otherwise(1.0)).alias("mass"))
    total = Window.partitionBy()
    run = F.sum("mass").over(Window.orderBy("lang"))
    bounds = mass.select("lang", (run - F.col("mass")).alias("lo"), run.alias("hi"), F.sum("mass").over(total).alias("total"))  # one row a source
    u = uniform(key(42, 0, F.col("pos")))
    return o.select("pos", u.alias("u")).join(F.broadcast(bounds), (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi"))).select("pos", "lang")


_POINTS = blend.resolve_points([(0, 1.0), (0.25, 0.5), (0.8, 0.1), (1000, 0.0)], 1000)


@query(f"select pos, step, round(case when step <= 0 then 1.0 when step <= 250 then 1.0 + (0.5 - 1.0) * (step - 0) / 250.0 when step <= 800 then 0.5 + (0.1 - 0.5) * (step - 250) / 550.0 when step <= 1000 then 0.1 + (0.0 - 0.1) * (step - 800) / 200.0 else 0.0 end::double, 9) as weight from (select pos, pos // 32 as step from {ORD})")
def schedule_weights(spark, d):
    o = ordered(spark, d).select("pos", F.floor(F.col("pos") / 32).alias("step"))
    return o.select("pos", "step", F.round(blend.schedule(F.col("step"), _POINTS), 9).alias("weight"))


@query(f"select pos, round(case when pos < 100 then 0.0 when pos >= 600 then 0.4 else 0.4 * (pos - 100) / 500.0 end::double, 9) as ratio from {ORD}")
def linear_ramp(spark, d):
    ramp = F.when(F.col("pos") < 100, 0.0).otherwise(blend.schedule(F.col("pos"), [(100, 0.0), (600, 0.4)]))
    return ordered(spark, d).select("pos", F.round(ramp, 9).alias("ratio"))


@query("select event_type as key, count(distinct user_id % 3) as n_sources from events group by 1 having count(distinct user_id % 3) = 3")
def key_intersection(spark, d):
    """Keys that all sources have."""
    e = t(spark, d, "events").select("event_type", F.pmod("user_id", F.lit(3)).alias("source"))
    return e.groupBy(F.col("event_type").alias("key")).agg(F.count_distinct("source").alias("n_sources")).where("n_sources = 3")


@query("select doc_id as id, text, 'docs' as source_tag from documents union all select item_id, text, 'bench' from benchmark")
def uniform_union(spark, d):
    a = t(spark, d, "documents").withColumnRenamed("doc_id", "id")
    b = t(spark, d, "benchmark").withColumnRenamed("item_id", "id")
    return blend.uniform_union([a, b], ["docs", "bench"])


@query("with s as (select event_type, max(user_id) + 1 as total from events group by 1), o as (select event_type, coalesce(sum(total + 1) over (order by event_type rows between unbounded preceding and 1 preceding), 0) as off from s) select distinct e.event_type, e.user_id, cast(o.off + e.user_id as bigint) as buffer_key from events e join o using (event_type)")
def namespaced_keys(spark, d):
    e = t(spark, d, "events").select("event_type", "user_id").distinct()
    s = e.groupBy("event_type").agg((F.max("user_id") + 1).alias("total"))
    off = s.select("event_type", F.coalesce(F.sum(F.col("total") + 1).over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return e.join(F.broadcast(off), "event_type").select("event_type", "user_id", (F.col("off") + F.col("user_id")).alias("buffer_key"))


@query("select doc_id, lang, cast(case lang when 'en' then 0 when 'de' then 1 when 'es' then 2 when 'fr' then 3 else -1 end as integer) as source_idx from documents")
def source_index(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", (F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int") - 1).alias("source_idx"))
