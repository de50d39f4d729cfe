"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (equal role and text) of both conversations is rendered once as the prompt; what is
left of each is its completion.  A mask marks, for every white-space token of a completion, whether it is trained on:
tokens of an assistant's text and its end mark are, role headers and other roles' turns aren't.  Everything is one projection of
built-in array functions, and is the same in one query of SQL.

A turn renders as "<|role|>" newline text newline "<|end|>" newline.

Cases: a null or unknown conversation counts as having no turns; a turn's null role or text counts as empty; pairs whose conversations are
equal, or of which a completion is empty, give no row (nothing is preferred); repeated rows give repeated pairs; turns with
equal numbers are ordered by role, then text; extra columns are ignored; empty tables give no rows; texts of any length are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ident

END = "<|end|>"
_SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"\n{END}\n"))), "")


def _mask(turns: Column) -> Column:
    """A 0 or 1 for each white-space token of the rendered turns."""

    def of(t: Column) -> Column:
        n = F.size(F.filter(F.split(t["text"], _SPACE), lambda w: w != ""))
        head = F.size(F.filter(F.split(t["role"], _SPACE), lambda w: w != ""))
        # the header is one token, but for a role with spaces inside
        return F.concat(F.repeat(F.lit("0"), F.greatest(head, F.lit(1))), F.repeat(F.when(t["role"] == "assistant", "1").otherwise("0"), n + 1))

    return F.array_join(F.transform(turns, of), "")


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation; rows without a conv_id or turn are left out."""
    rows = turns.select(ident(conv_col).alias("conv_id"), ident(turn_col).cast("long").alias("turn"), F.coalesce(ident(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(ident(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null")
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return got.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs of array<struct<role, text>>."""
    none = F.array().cast("array<struct<role:string,text:string>>")

    def clean(c: str) -> Column:
        turns = F.coalesce(ident(c), none)
        return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    got = pairs.select(ident(id_col).alias("pair_id"), clean(chosen_col).alias("c"), clean(rejected_col).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    # the first turn that differs ends the prefix
    differ = F.array_position(F.zip_with(F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda a, b: ~a.eqNullSafe(b)), True)
    got = got.withColumn("n", F.when(differ > 0, differ.cast("int") - 1).otherwise(shorter)).where(F.col("n") < shorter)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c) - F.col("n"))
    return got.select(
        "pair_id", F.col("n").alias("prompt_turns"), _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _render(rest("r")).alias("rejected"), _mask(rest("c")).alias("chosen_mask"), _mask(rest("r")).alias("rejected_mask"),
    )


def contrast(turns: DataFrame, **cols: str) -> DataFrame:
    """(pair_id, chosen, rejected) from plain conversations: each, up to its last reply, against itself with that reply replaced.

    The replacing reply is the last one of the partner conversation (ids 2k and 2k + 1 are partners); empty if there is none.
    """
    got = conversations(turns, **cols).withColumn("conv_id", F.col("conv_id").cast("long"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)))
    got = got.withColumn("n", last).where("n > 0").select("conv_id", F.slice("turns", F.lit(1), F.col("n")).alias("turns"))
    reply = got.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.element_at("turns", -1)["text"].alias("other"))
    both = got.join(reply, "conv_id", "left")
    swapped = F.struct(F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    rejected = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(swapped))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
last as (select conv_id, max_by({'turn': turn, 'role': role, 'text': text}, {'turn': turn, 'role': role, 'text': text}) as l from t where role = 'assistant' group by conv_id),
pairs as (select a.conv_id, a.l, coalesce(b.l.text, '') as other from last a left join last b on b.conv_id = xor(a.conv_id, 1) where a.l.text <> coalesce(b.l.text, '')),
prompt as (
  select p.conv_id, count(t.turn) as n, coalesce(string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' order by t.turn, t.role, t.text), '') as prompt
  from pairs p left join t on t.conv_id = p.conv_id and (t.turn, t.role, t.text) < (p.l.turn, p.l.role, p.l.text) group by p.conv_id)
select conv_id as pair_id, cast(n as integer) as prompt_turns, prompt,
  '<|assistant|>' || chr(10) || l.text || chr(10) || '<|end|>' || chr(10) as chosen, '<|assistant|>' || chr(10) || other || chr(10) || '<|end|>' || chr(10) as rejected,
  '0' || repeat('1', 1 + len(list_filter(regexp_split_to_array(l.text, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))) as chosen_mask,
  '0' || repeat('1', 1 + len(list_filter(regexp_split_to_array(other, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))) as rejected_mask
from pairs join prompt using (conv_id)
"""
