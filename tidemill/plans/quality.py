"""Projections, casts, quality gates and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cast as C
from ..operators import episode as E
from ..operators import order
from ..operators import quality as Q
from .registry import query, t

NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven"]
BADV = "case when event_id % 17 = 0 then 'nan'::double when event_id % 23 = 0 then 'inf'::double else value end"
FAULT = f"(select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, {BADV} as v from events)"


def faulty(spark, d):
    e = t(spark, d, "events")
    bad = F.when(F.pmod("event_id", F.lit(17)) == 0, float("nan")).when(F.pmod("event_id", F.lit(23)) == 0, float("inf")).otherwise(F.col("value"))
    return E.frames(e.select("event_id", "user_id", "ts", bad.alias("v")), "user_id", "ts", "event_id").select("event_id", "user_id", "frame", "v")


@query("select vec_id, label::bigint as class_label from embeddings")
def class_label(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("class_label"))


@query(f"select vec_id, 'a photo of ' || case when label between 0 and 7 then {NAMES}[label + 1] else 'unknown' end as caption from embeddings")
def text_from_label(spark, d):
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in NAMES]), F.col("label")), F.lit("unknown"))
    return t(spark, d, "embeddings").select("vec_id", F.replace(F.lit("a photo of {}"), F.lit("{}"), name).alias("caption"))


@query("select conv_id, min_by(text, turn) as caption from conversations group by 1")
def text_caption(spark, d):
    """The first item of a list of texts."""
    lists = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return lists.select("conv_id", F.element_at("x", 1)["text"].alias("caption"))


@query("select event_id, cast((event_id * 37 + 128) % 256 - 128 as tinyint) as small, cast((event_id * 37) % 65536 as integer) as unsigned, cast(value as float)::double as single from events")
def cast_paths(spark, d):
    e = t(spark, d, "events").select("event_id", F.struct((F.col("event_id") * 37).alias("a"), F.struct((F.col("event_id") * 37).alias("b"), F.col("value").alias("c")).alias("inner")).alias("s"))
    got = C.cast_paths(e, {"s.a": "int8", "s.inner.b": "uint16", "s.inner.c": "float32", "s.none": "int8"})
    return got.select("event_id", F.col("s.a").alias("small"), F.col("s.inner.b").alias("unsigned"), F.col("s.inner.c").cast("double").alias("single"))


@query("select event_id, cast(value as float)::double as working from events")
def wire_working_cast(spark, d):
    wire = C.to(F.col("value"), "float32")
    return t(spark, d, "events").select("event_id", wire.cast(C.SPARK[C.work_dtype("float32", None, "float64")]).alias("working"))


def _rounded(bits, low):
    u = f"pow(2.0, greatest(floor(log2(abs(x))), {low}) - {bits - 1})"
    return f"case when x = 0 then 0 else round_even(x / {u}, 0) * {u} end"


@query(f"with e as (select vec_id, unnest(embedding)::double as x from embeddings) select vec_id, max(abs(x - {_rounded(11, -14)})) as half_error, max(abs(x - {_rounded(8, -126)})) as bfloat_error from e group by 1")
def half_precision(spark, d):
    """Embeddings on the half and bfloat16 grids: the largest error of each."""
    x = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    x = x.select("vec_id", F.col("x").cast("double").alias("x"), C.to(F.col("x"), "float16").cast("double").alias("h"), C.to(F.col("x"), "bfloat16").cast("double").alias("b"))
    return x.groupBy("vec_id").agg(F.max(F.abs(F.col("x") - F.col("h"))).alias("half_error"), F.max(F.abs(F.col("x") - F.col("b"))).alias("bfloat_error"))


@query("select event_id, value as value_out, user_id as user_out, event_type from events")
def path_remap(spark, d):
    got = C.remap(t(spark, d, "events").select("event_id", "value", "user_id", "event_type"), {"value": "obs.state.value", "user_id": "obs.user"})
    return got.select("event_id", F.col("obs.state.value").alias("value_out"), F.col("obs.user").alias("user_out"), "event_type")


@query("select doc_id, lang from documents")
def key_filter(spark, d):
    docs = t(spark, d, "documents")
    return docs.select(*[c for c in docs.columns if c in {"doc_id", "lang", "absent"}])


@query(f"select event_id, v from {FAULT} where not isnan(v) and not isinf(v)")
def valid_rows(spark, d):
    f = faulty(spark, d)
    return f.where(~Q.invalid(f)).select("event_id", "v")


@query(f"select event_id, case when isnan(v) then 'nan' else 'inf' end as reason from {FAULT} where isnan(v) or isinf(v)")
def invalid_reason(spark, d):
    return faulty(spark, d).select("event_id", Q.reason(F.col("v")).alias("reason")).where("reason is not null")


@query("select case when event_id % 17 = 0 then 'before' when value * 1e38 * 100 > 3.4028235677973366e38 then 'by cast' else 'none' end as origin, count(*) as n from events group by 1")
def cast_nan_audit(spark, d):
    """Which invalid numbers a cast to single precision made, and which were there."""
    v = F.when(F.pmod("event_id", F.lit(17)) == 0, float("nan")).otherwise(F.col("value") * 1e38 * 100)
    before, after = Q.reason(v).isNotNull(), Q.reason(v.cast("float").cast("double")).isNotNull()
    return t(spark, d, "events").select(F.when(before, "before").when(after, "by cast").otherwise("none").alias("origin")).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"with f as (select event_id, user_id, frame, not isnan(v) and not isinf(v) as ok from {FAULT}) select event_id, coalesce(min(case when ok then frame end) over (partition by user_id order by frame rows between current row and unbounded following), min(case when ok then frame end) over (partition by user_id)) as next_pos from f")
def next_valid(spark, d):
    return Q.next_valid(faulty(spark, d), ["user_id"], "frame", Q.reason(F.col("v")).isNull()).select("event_id", "next_pos")


@query(f"with f as (select user_id, frame, isnan(v) or isinf(v) as bad from {FAULT}), g as (select *, frame - row_number() over (partition by user_id, bad order by frame) as g from f) select user_id, min(frame) as first, count(*) as length, count(*) >= 3 as over_budget from g where bad group by user_id, g")
def error_runs(spark, d):
    r = Q.runs(faulty(spark, d), ["user_id"], "frame", Q.reason(F.col("v")).isNotNull()).where("value")
    return r.select("user_id", "first", "length", (F.col("length") >= 3).alias("over_budget"))


@query(f"select coalesce(case when isnan(v) then 'nan' when isinf(v) then 'inf' end, 'ok') as kind, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as rate from {FAULT} group by 1")
def error_summary(spark, d):
    g = faulty(spark, d).groupBy(F.coalesce(Q.reason(F.col("v")), F.lit("ok")).alias("kind")).agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


@query("with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) select event_type, max(case when i = n // 2 then value end) as p50, max(case when i = cast(floor(n * 0.95) as bigint) then value end) as p95, max(case when i = cast(floor(n * 0.99) as bigint) then value end) as p99, round(avg(value), 6) as mean from s group by 1")
def latency_stats(spark, d):
    """Exact percentiles by index; a group is sorted in 1,024 ranges of its values."""
    e = t(spark, d, "events").select("event_type", "value")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.avg("value").alias("mean"))  # one row a type
    placed = e.join(F.broadcast(ends), "event_type")
    s = order.numbered_in(placed, ["event_type"], F.floor(1023 * (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))), [F.col("value")], "i")
    at = lambda q: F.max(F.when(F.col("i") == q, F.col("value")))
    return s.groupBy("event_type").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95"), at(F.floor(F.col("n") * 0.99)).alias("p99"), F.round(F.first("mean"), 6).alias("mean"))


@query("with recursive f as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events), e as (select user_id, i, n, value as ema from f where i = 1 union all select f.user_id, f.i, f.n, 0.1 * f.value + 0.9 * e.ema from e join f on f.user_id = e.user_id and f.i = e.i + 1) select user_id, round(ema, 6) as ema from e where i = n")
def ema(spark, d):
    """The last value of the moving average, as a sum with falling weights: it is partly added up before rows meet, and no history is held."""
    f = E.frames(t(spark, d, "events").select("user_id", "value", "ts", "event_id"), "user_id", "ts", "event_id")
    weight = F.when(F.col("frame") == 0, F.lit(1.0)).otherwise(F.lit(0.1)) * F.pow(F.lit(0.9), F.col("n") - 1 - F.col("frame"))
    return f.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))


@query("select round(100.0 * (count(*) - count(distinct user_id)) / count(*), 6) as resample_pct, round(count(*) * 1.0 / count(distinct user_id), 6) as reads_per_doc from events")
def resample_ratio(spark, d):
    g = t(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return g.select(F.round(100.0 * (F.col("n") - F.col("u")) / F.col("n"), 6).alias("resample_pct"), F.round(F.col("n") / F.col("u"), 6).alias("reads_per_doc"))


POS = "(select doc_id, source, row_number() over (order by md5('42:0:' || doc_id), doc_id) - 1 as pos from documents)"


def shuffled(spark, d):
    return order.permutation(t(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query(f"with c as (select pos // 32 as batch, source, count(*) as c from {POS} group by 1, 2), p as (select batch, c * 1.0 / sum(c) over (partition by batch) as p from c) select batch, round(-sum(p * ln(p) / ln(2)), 6) as entropy from p group by 1")
def batch_entropy(spark, d):
    c = shuffled(spark, d).groupBy(F.floor(F.col("pos") / 32).alias("batch"), "source").agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("batch")))
    return p.groupBy("batch").agg(F.round(-F.sum(F.col("p") * F.log("p") / F.log(F.lit(2.0))), 6).alias("entropy"))


@query(f"select pos // 100 as block, count(distinct source) as n_sources from {POS} group by 1")
def window_diversity(spark, d):
    return shuffled(spark, d).groupBy(F.floor(F.col("pos") / 100).alias("block")).agg(F.count_distinct("source").alias("n_sources"))


@query(f"with s as (select pos, cast(substr(source, 4) as double) as x from {POS}), m as (select avg(x) as mu, var_pop(x) as var from s) select k, round(sum((a.x - mu) * (b.x - mu)) / count(*) / any_value(var), 6) as autocorr from s a join (values (1), (2), (5)) l(k) on true join s b on b.pos = a.pos + k, m group by k")
def shard_autocorr(spark, d):
    s = shuffled(spark, d).select("pos", F.substring("source", 4, 9).cast("double").alias("x"))
    m = s.agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    left = s.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).withColumn("other", F.col("pos") + F.col("k"))
    both = left.join(s.select(F.col("pos").alias("other"), F.col("x").alias("y")), "other").crossJoin(F.broadcast(m))  # one row
    return both.groupBy("k").agg(F.round(F.sum((F.col("x") - F.col("mu")) * (F.col("y") - F.col("mu"))) / F.count("*") / F.first("var"), 6).alias("autocorr"))


@query("with c as (select source, count(*) as c from documents group by 1) select round(sum((c - m) * (c - m) / m), 6) as chi2, min(c) as least, max(c) as most, round(stddev_pop(c) / any_value(m), 6) as cv from c, (select avg(c) as m from c)")
def coverage_chi2(spark, d):
    c = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"))
    s = c.agg(F.count("*").alias("k"), F.avg("c").alias("m"), F.var_pop("c").alias("v"), F.min("c").alias("least"), F.max("c").alias("most"))
    return s.select(F.round(F.col("v") * F.col("k") / F.col("m"), 6).alias("chi2"), "least", "most", F.round(F.sqrt("v") / F.col("m"), 6).alias("cv"))


@query("with f as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events), g as (select user_id, event_type, frame - row_number() over (partition by user_id, event_type order by frame) as g from f), r as (select count(*) as length from g group by user_id, event_type, g) select round(avg(length), 6) as mean, max(length) as longest, median(length) as median, round(quantile_cont(length, 0.95), 6) as p95, count(*) as runs from r")
def run_lengths(spark, d):
    f = E.frames(t(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id")
    r = Q.runs(f, ["user_id"], "frame", F.col("event_type"))
    return r.agg(F.round(F.avg("length"), 6).alias("mean"), F.max("length").alias("longest"), F.median("length").alias("median"), F.round(F.percentile("length", F.lit(0.95)), 6).alias("p95"), F.count("*").alias("runs"))


@query("select label, sum(len(embedding)) * 4 as bytes_float32, sum(len(embedding)) * 2 as bytes_float16, 50.0::double as saved_pct from embeddings group by 1")
def memory_savings(spark, d):
    n = F.sum(F.size("embedding"))
    return t(spark, d, "embeddings").groupBy("label").agg((n * C.WIDTH["float32"]).alias("bytes_float32"), (n * C.WIDTH["float16"]).alias("bytes_float16")).withColumn("saved_pct", 100.0 * (1 - F.col("bytes_float16") / F.col("bytes_float32")))
