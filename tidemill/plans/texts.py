"""Tokenizing, packing, chat, adapters and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapters, blend, order
from ..operators import text as X
from ..sources.shared import written
from .registry import query, t

SP = "'[ \\t\\n\\r]+'"
TOK = f"(select doc_id, lang, list_filter(regexp_split_to_array(text, {SP}), lambda w: w <> '') as tokens from documents)"
VOC = f"(select token, cast(dense_rank() over (order by encode(token)) + 1 as integer) as id from (select distinct unnest(tokens) as token from {TOK}))"
LONG = f"(select doc_id, p, v.id from (select doc_id, unnest(tokens) as token, unnest(range(len(tokens))) as p from {TOK}) join {VOC} v using (token))"
IDS = f"(select doc_id, row_number() over (order by doc_id) - 1 as pos, lang, coalesce(ids, []) as ids from documents left join (select doc_id, list(id order by p) as ids from {LONG} group by 1) using (doc_id))"


def ids(spark, d):
    """(doc_id, lang, ids): token ids by the vocabulary of distinct words."""
    docs = t(spark, d, "documents").select("doc_id", "lang", X.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return X.token_ids(docs, "doc_id")


def positioned(spark, d):
    """ids, written once, and (doc_id, pos) of each document; only keys are put in order."""
    got = written(ids(spark, d), "zstd")
    return got.select("doc_id", "ids"), order.by_number(got.select("doc_id"), "doc_id")


def packed(spark, d, flush=True):
    got, places = positioned(spark, d)
    return X.pack(got, 64, flush=flush, positions=places)


@query("select doc_id, n_chars from documents where regexp_matches(text, '[^ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x85\\xa0]')")
def nonblank(spark, d):
    return t(spark, d, "documents").where(F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x85\\xa0]")).select("doc_id", "n_chars")


@query(f"select doc_id, array_to_string(ids, ' ') as ids, len(ids) as n from {IDS}")
def tokenize_ws(spark, d):
    return ids(spark, d).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.size("ids").cast("bigint").alias("n"))


PACK = f"""with d as (select pos, list_concat(ids, [1]) as ids from {IDS} where len(ids) > 0), o as (select ids, coalesce(sum(len(ids)) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as off from d),
g as (select off + unnest(range(len(ids))) as g, unnest(ids) as id from o), c as (select g // 64 as chunk, list(id order by g) as ids from g group by 1)"""


@query(f"{PACK} select chunk, array_to_string(list_concat(ids, [1 for _ in range(64)])[1:64], ' ') as input_ids from c")
def pack_flush(spark, d):
    return packed(spark, d).select("chunk", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(f"{PACK} select chunk, array_to_string(ids, ' ') as input_ids from c where len(ids) = 64")
def pack_chunks(spark, d):
    return packed(spark, d, flush=False).select("chunk", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


PADDED = f"(select doc_id, lang, list_concat(ids, [0 for _ in range(64)])[1:64] as input_ids, ids from {IDS})"


def padded(spark, d):
    return ids(spark, d).select("doc_id", "lang", X.pad(F.col("ids"), 64).alias("input_ids"), F.size("ids").alias("n"))


def joined(c):
    return F.array_join(F.col(c).cast("array<string>") if c != "loss_mask" else F.transform(c, lambda x: x.cast("int").cast("string")), " ").alias(c)


@query(f"select doc_id, array_to_string(input_ids, ' ') as input_ids, least(len(ids), 64) as length from {PADDED}")
def token_pad_truncate(spark, d):
    return padded(spark, d).select("doc_id", joined("input_ids"), F.least("n", F.lit(64)).cast("bigint").alias("length"))


MASK = "array_to_string([(x <> 0)::integer for x in input_ids], ' ')"


@query(f"select doc_id, {MASK} as loss_mask from {PADDED}")
def loss_mask_pad(spark, d):
    return padded(spark, d).withColumn("loss_mask", X.pad_mask(F.col("input_ids"))).select("doc_id", joined("loss_mask"))


@query(f"select doc_id, array_to_string([1 for x in ids], ' ') as loss_mask from {IDS}")
def loss_mask_full(spark, d):
    return ids(spark, d).withColumn("loss_mask", X.full_mask(F.col("ids"))).select("doc_id", joined("loss_mask"))


@query(f"select doc_id, array_to_string(ids, ' ') as input_ids, array_to_string(ids, ' ') as labels from {IDS}")
def causal_labels(spark, d):
    return ids(spark, d).select("doc_id", F.col("ids").alias("input_ids"), F.col("ids").alias("labels")).select("doc_id", joined("input_ids"), joined("labels"))


@query(f"select doc_id, array_to_string(input_ids, ' ') as input_ids, array_to_string(input_ids, ' ') as labels, {MASK} as loss_mask, 'pretrain_pad' as source_tag from {PADDED}")
def adapt_pretrain(spark, d):
    return adapters.adapt(padded(spark, d), "pretrain", ["doc_id"]).select("doc_id", joined("input_ids"), joined("labels"), joined("loss_mask"), "source_tag")


@query(f"select doc_id, array_to_string(ids, ' ') as input_ids, array_to_string([1 for x in ids], ' ') as loss_mask, 'val_full' as source_tag from {IDS}")
def adapt_val(spark, d):
    return adapters.adapt(ids(spark, d).withColumnRenamed("ids", "input_ids"), "val", ["doc_id"]).select("doc_id", joined("input_ids"), joined("loss_mask"), "source_tag")


PAIRS = "(select a.conv_id, a.turn, a.text as query, b.text as response from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"
CHAT = f"(select conv_id, turn, list_filter(regexp_split_to_array('[Q] ' || query || ' [R]', {SP}), lambda w: w <> '') as q, list_filter(regexp_split_to_array(response || ' [E]', {SP}), lambda w: w <> '') as r from {PAIRS})"


def chat(spark, d):
    c = t(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    r = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return q.join(r, ["conv_id", "turn"]).select("conv_id", "turn", X.tokens(F.concat_ws(" ", F.lit("[Q]"), "query", F.lit("[R]"))).alias("q"), X.tokens(F.concat_ws(" ", "response", F.lit("[E]"))).alias("r"))


def templated(spark, d, size=128):
    both = F.concat("q", "r")
    padded_ = F.slice(F.concat(both, F.array_repeat(F.lit("[P]"), size)), 1, size)
    kept = chat(spark, d).where(F.size(both) <= size)
    return kept.select("conv_id", "turn", padded_.alias("tokens"), F.size("q").alias("nq"), F.size(both).alias("nt")).withColumn("loss_mask", X.span_mask(F.col("tokens"), F.col("nq"), F.col("nt")))


KEPT = f"(select conv_id, turn, list_concat(list_concat(q, r), ['[P]' for _ in range(128)])[1:128] as tokens, array_to_string([(i >= len(q) and i < len(q) + len(r))::integer for i in range(128)], ' ') as loss_mask from {CHAT} where len(q) + len(r) <= 128)"


@query(f"select conv_id, turn, array_to_string(tokens, ' ') as tokens, loss_mask from {KEPT}")
def chat_template(spark, d):
    return templated(spark, d).select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), joined("loss_mask"))


@query(f"select conv_id, turn, len(q) + len(r) as n_tokens from {CHAT} where len(q) + len(r) > 128")
def chat_dropped(spark, d):
    return chat(spark, d).select("conv_id", "turn", (F.size("q") + F.size("r")).cast("bigint").alias("n_tokens")).where("n_tokens > 128")


@query(f"select conv_id, turn, cast(row_number() over (order by md5('42:0:' || conv_id || ':' || turn), conv_id, turn) - 1 as bigint) as pos, cast((row_number() over (order by md5('42:0:' || conv_id || ':' || turn), conv_id, turn) - 1) % 4 as integer) as worker from {KEPT}")
def chat_dataset(spark, d):
    from ..functions.rng import key

    p = order.by_digest(templated(spark, d).select("conv_id", "turn"), key(42, 0, F.col("conv_id"), F.col("turn")), F.col("conv_id"), F.col("turn"))
    return p.withColumn("worker", F.pmod("pos", F.lit(4)).cast("int"))


@query(f"select conv_id, turn, array_to_string(tokens, ' ') as tokens, array_to_string(tokens, ' ') as labels, loss_mask, 'chat_query' as source_tag from {KEPT}")
def adapt_chat(spark, d):
    got = adapters.adapt(templated(spark, d).withColumnRenamed("tokens", "input_ids"), "chat", ["conv_id", "turn"])
    return got.select("conv_id", "turn", F.array_join("input_ids", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"), joined("loss_mask"), "source_tag")


@query("select doc_id, lang, source, source as source_tag from documents")
def source_tag(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source", F.col("source").alias("source_tag"))


BAD = f"(select doc_id, input_ids, [case when doc_id % 17 = 0 then true else x <> 0 end for x in input_ids] as mask from {PADDED})"


def broken(spark, d):
    """Masks with a fault in every 17th document."""
    return padded(spark, d).withColumn("mask", F.transform("input_ids", lambda x: F.when(F.pmod("doc_id", F.lit(17)) == 0, True).otherwise(x != 0)))


@query(f"select doc_id from {BAD} where list_count(list_filter(list_zip(input_ids, mask), lambda z: (z[1] <> 0) <> z[2])) > 0")
def invariant_pretrain(spark, d):
    return broken(spark, d).where(F.exists(F.arrays_zip("input_ids", "mask"), lambda z: (z["input_ids"] != 0) != z["mask"])).select("doc_id")


@query("select conv_id, turn from " + KEPT + " where conv_id % 7 = 0 or not (contains(loss_mask, '0') and contains(loss_mask, '1'))")
def invariant_chat(spark, d):
    """Masks that don't tell query from reply; every seventh conversation is given one."""
    mask = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.transform("loss_mask", lambda x: F.lit(True))).otherwise(F.col("loss_mask"))
    rows = templated(spark, d).withColumn("loss_mask", mask)
    return rows.where(~(F.exists("loss_mask", lambda x: x) & F.exists("loss_mask", lambda x: ~x))).select("conv_id", "turn")


@query(f"select doc_id from {BAD} where list_bool_and(mask) is distinct from true")
def invariant_val(spark, d):
    return broken(spark, d).where(~F.forall("mask", lambda x: x)).select("doc_id")


@query(f"select 'pretrain_pad' as source, 'mask' as rule, doc_id as id from {BAD} where doc_id % 17 = 0 and list_contains(input_ids, 0) union all select 'any', 'empty', doc_id from {IDS} where len(ids) = 0")
def schema_violations(spark, d):
    """Both rules in one pass over the ids."""
    fault = F.exists(F.arrays_zip("input_ids", "mask"), lambda z: (z["input_ids"] != 0) != z["mask"])

    def rule(source, name):
        return F.struct(F.lit(source).alias("source"), F.lit(name).alias("rule"))

    found = F.array_compact(F.array(F.when(fault, rule("pretrain_pad", "mask")), F.when(F.col("n") == 0, rule("any", "empty"))))
    return broken(spark, d).select(F.explode(found).alias("v"), F.col("doc_id").alias("id")).select("v.source", "v.rule", "id")


@query("select doc_id, pos, batch_id from (select doc_id, pos, pos // 32 as batch_id from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents)) where batch_id = 0 or (batch_id + 1) % 10 = 0")
def probe_batches(spark, d):
    o = order.batches(order.by_number(t(spark, d, "documents").select("doc_id"), "doc_id"), 32)
    return o.where((F.col("batch_id") == 0) | (F.pmod(F.col("batch_id") + 1, F.lit(10)) == 0)).select("doc_id", "pos", "batch_id")


U = "(cast('0x' || substr(md5('42:0:' || chunk), 1, 13) as bigint) / 4503599627370496.0)"


@query(f"{PACK}, x as (select chunk, array_to_string(list_concat(ids, [1 for _ in range(64)])[1:64], ' ') as input_ids, case when {U} < 0.7 then 0 else 1 end as source_idx from c) select chunk, input_ids, source_idx, chunk // 32 as batch_id, 'pretrain_pad' as source_tag from x")
def flagship(spark, d):
    """Blank filter, tokens, packing, adapter, blend draw and batches in one plan."""
    from ..functions.rng import key, uniform

    chunks = packed(spark, d).withColumn("source_idx", blend.draw(uniform(key(42, 0, F.col("chunk"))), [0.7, 0.3]))
    return chunks.select("chunk", joined("input_ids"), "source_idx", F.floor(F.col("chunk") / 32).alias("batch_id"), F.lit("pretrain_pad").alias("source_tag"))


