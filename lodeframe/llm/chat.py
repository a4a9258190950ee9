"""Preference formatting for chat data, in DataFrame functions only.

The turns that a chosen and a rejected conversation share from the start are
rendered once, as the prompt; the rest of each is a completion.  Spans tell
which characters of a completion are learned: what assistants say, with the
closing tag; all else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import next_value

END = "<|end|>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(END + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """array<struct<start, end>> in code points of the rendered turns."""
    span = "array<struct<start:int,end:int>>"

    def add(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.char_length(_head(turn))
        end = start + F.char_length(turn["text"]) + len(END)
        one = F.when(turn["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], one).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")), add, lambda acc: acc["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text), turns as array<struct<role, text>>.

    In order of turn, null first, then role and text.  Null texts are empty,
    null roles ``unknown``; rows without a conv_id are left out.  A conversation
    is one training example, so its turns are put together in one row.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def next_as_rejected(talks: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation against itself with the last reply of the next one.

    The next is by conv_id, the first after the last.  The reply takes the place
    and role of the conversation's own last turn.
    """
    following = next_value(talks.select("conv_id"), "conv_id", "next_id")
    replies = talks.select(F.col("conv_id").alias("next_id"), F.element_at("turns", -1)["text"].alias("reply"))
    paired = talks.join(following, "conv_id").join(replies, "next_id")
    own = F.struct(F.element_at("turns", -1)["role"].alias("role"), F.col("reply").alias("text"))
    rejected = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(own))
    return paired.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) of pairs of conversations.

    ``chosen`` and ``rejected`` come as array<struct<role, text>> and leave as
    the rendered completions.  If one conversation starts with the whole of the
    other, or they are equal, the completion of what has no more turns is empty.
    Null arrays are empty ones; repeated rows are formatted one by one.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    # A shorter side is padded with nulls, which differ from any turn.
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int")
    cut = both.select("pair_id", "a", "b", common.alias("prefix_turns"))
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.size(c))
    cut = cut.select("pair_id", "prefix_turns", F.slice("a", F.lit(1), F.col("prefix_turns")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "pair_id", "prefix_turns", _text(F.col("p")).alias("prompt"), _text(F.col("a")).alias("chosen"), _text(F.col("b")).alias("rejected"),
        _spans(F.col("a")).alias("chosen_spans"), _spans(F.col("b")).alias("rejected_spans"),
    )
