"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows (conv_id, turn, role, text).

    Null roles count as user, null texts as empty. Equal rows count once; different rows of one turn number follow each other by role and text.
    Rows without conv_id or turn take no part.
    """
    rows = conversations.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _tail(turns: Column, start: Column) -> Column:
    return F.slice(turns, start + 1, F.size(turns))


def _segments(prompt: Column, tail: Column) -> Column:
    """Pieces of prompt and completion in order, each with whether a loss counts there: the texts of assistant turns and their ends."""
    piece = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    parts = F.flatten(F.transform(tail, lambda t: F.array(
        piece(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)), F.lit(False)), piece(F.concat(t["text"], F.lit(CLOSE)), t["role"] == "assistant"))))
    return F.concat(F.array(piece(prompt, F.lit(False))), parts)


def preferences(pairs: DataFrame) -> DataFrame:
    """Paired masked completions from (pair_id, chosen, rejected), two arrays of (role, text).

    The longest common prefix of turns, alike in role and text, is rendered once as prompt; what follows on either side is a
    completion. Segments cover prompt and completion; `train` marks what a loss counts on: the assistant's words after the prompt.
    prefers is false where the two sides are the same. A null side is a conversation without turns. Extra columns are ignored.
    """
    none = F.from_json(F.lit("[]"), "array<struct<role: string, text: string>>")
    p = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    upto = F.least(F.size("chosen"), F.size("rejected"))
    # the first place at which the two sides differ
    differ = F.filter(F.sequence(F.lit(0), upto), lambda i: (i == upto) | (F.get("chosen", i) != F.get("rejected", i)))
    p = p.withColumn("n_prompt", F.array_min(differ))
    p = p.withColumn("prompt", _render(F.slice("chosen", 1, F.greatest(F.col("n_prompt"), F.lit(0)))))
    p = p.withColumn("chosen_tail", _tail(F.col("chosen"), F.col("n_prompt"))).withColumn("rejected_tail", _tail(F.col("rejected"), F.col("n_prompt")))
    return p.select(
        "pair_id", F.col("n_prompt").cast("long").alias("n_prompt_turns"), "prompt", _render(F.col("chosen_tail")).alias("chosen"), _render(F.col("rejected_tail")).alias("rejected"),
        _segments(F.col("prompt"), F.col("chosen_tail")).alias("chosen_segments"), _segments(F.col("prompt"), F.col("rejected_tail")).alias("rejected_segments"),
        (F.col("chosen_tail") != F.col("rejected_tail")).alias("prefers"))


def parroted(turns: DataFrame) -> DataFrame:
    """Pairs for a table of single conversations (conv_id, turns): chosen is the conversation up to its last assistant turn, rejected the same
    with that turn's text replaced by the text before it (a reply that parrots; empty if nothing is before it).

    Conversations without assistant turns give no pair.
    """
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    last = turns.filter(F.exists("turns", lambda t: t["role"] == "assistant")).withColumn("last", F.array_max(places))
    said = F.coalesce(F.get("turns", F.col("last") - 1)["text"], F.lit(""))
    reply = F.struct(F.lit("assistant").alias("role"), said.alias("text"))
    return last.select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("last") + 1).alias("chosen"), F.concat(F.slice("turns", 1, F.col("last")), F.array(reply)).alias("rejected"))


def trained_chars(segments: Column) -> Column:
    """Number of characters that a loss counts on."""
    return F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.when(s["train"], F.length(s["text"])).otherwise(0).cast("long"))


#: The query on DuckDB: the same prompts and completions, put together by joins and ordered aggregates.
ORACLE = """
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
n as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from t),
l as (select conv_id, max(k) as last from n where role = 'assistant' group by conv_id),
b as (select l.conv_id, l.last, a.text as chosen, coalesce(p.text, '') as rejected
      from l join n a on a.conv_id = l.conv_id and a.k = l.last left join n p on p.conv_id = l.conv_id and p.k = l.last - 1),
q as (select b.conv_id, max(case when b.chosen = b.rejected then b.last else b.last - 1 end) as same from b group by b.conv_id),
r as (select n.conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by k) as prompt
      from n join q on n.conv_id = q.conv_id and n.k <= q.same group by n.conv_id)
select b.conv_id as pair_id, cast(q.same as bigint) as n_prompt_turns, coalesce(r.prompt, '') as prompt,
  case when b.chosen = b.rejected then '' else '<|assistant|>' || chr(10) || b.chosen || '<|end|>' || chr(10) end as chosen,
  case when b.chosen = b.rejected then '' else '<|assistant|>' || chr(10) || b.rejected || '<|end|>' || chr(10) end as rejected,
  cast(case when b.chosen = b.rejected then 0 else length(b.chosen) + 8 end as bigint) as chosen_trained,
  cast(case when b.chosen = b.rejected then 0 else length(b.rejected) + 8 end as bigint) as rejected_trained,
  b.chosen <> b.rejected as prefers
from b join q using (conv_id) left join r using (conv_id)
"""
