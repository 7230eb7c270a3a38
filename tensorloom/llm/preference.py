"""Preference formatting of pairs of conversations: the longest common prefix of turns as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: How a turn begins and ends; the marker in a text is written with a blank.
OPEN, CLOSE, MARK = ("<|", "|>\n"), "<|end|>\n", "<|"


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order of turn, role and text; null roles and texts count as "".

    Rows without a conversation are left out; a null turn comes first; repeated rows are repeated turns.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_ = F.array_sort(F.collect_list(one))
    return conversations.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv")).agg(F.transform(sorted_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) != F.get(b, i))
    return F.coalesce(F.get(differ, F.lit(0)), n)


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN[0]), F.replace(role, F.lit(MARK), F.lit("< |")), F.lit(OPEN[1]))


def _body(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit(MARK), F.lit("< |")), F.lit(CLOSE))


def _render(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: F.concat(_head(x["role"]), _body(x["text"]))), "")


def _spans(t: Column, learn: str) -> Column:
    """(start, end) of each body of that role in the rendered turns, in characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(_head(x["role"]))
        end = begin + F.length(_body(x["text"]))
        return F.struct(end.alias("at"), F.when(x["role"] == learn, F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(t, start, step, lambda a: a["spans"])


def format_turns(pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """pairs, which hold the turns of both sides in a and b, with shared, prompt, chosen, rejected and the two masks in their place."""
    j = pairs.withColumn("shared", _prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))
    others = [c for c in pairs.columns if c not in ("a", "b")]
    return j.select(*others, "shared", _render(F.slice("a", 1, F.col("shared"))).alias("prompt"), _render(rest(F.col("a"))).alias("chosen"), _render(rest(F.col("b"))).alias("rejected"), let(rest(F.col("a")), lambda t: _spans(t, learn)).alias("chosen_mask"), let(rest(F.col("b")), lambda t: _spans(t, learn)).alias("rejected_mask"))


def format_pairs(pairs: DataFrame, conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """(pair, chosen_id, rejected_id, shared, prompt, chosen, rejected, chosen_mask, rejected_mask) for each (pair, chosen_id, rejected_id).

    shared is the number of common leading turns; prompt renders them once; chosen and rejected render the rest, and
    the masks hold the (start, end) characters of them to learn from: bodies of the role `learn`. A side whose
    conversation is missing has no turns, hence an empty completion and mask, and an empty prompt; of equal
    conversations all turns are prompt. Turns of any length are rendered whole, turns of equal number in order of role
    and text. Repeated pairs are formatted alike, an empty table gives an empty result. Other columns are not read.
    """
    t = turns(conversations)
    j = pairs.select("pair", "chosen_id", "rejected_id").join(t.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left").join(t.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
    empty = F.array().cast(t.schema["turns"].dataType)
    return format_turns(j.select("pair", "chosen_id", "rejected_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b")), learn)


def swapped_answers(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """(pair, chosen_id, rejected_id, a, b) for tables that name no pairs: each conversation against itself with its
    partner's last answer in place of its own.

    Conversations 2k and 2k + 1 are partners. a holds a conversation's turns, b those before its last turn of the role
    `learn` (all if there is none) and then the partner's last such turn, if there is a partner with one.
    """
    t = turns(conversations)
    own = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == learn)
    t = t.select("conv", "turns", F.array_max(own).alias("last"))
    answer = t.where("last IS NOT NULL").select((F.when(F.pmod("conv", F.lit(2)) == 0, F.col("conv") + 1).otherwise(F.col("conv") - 1)).alias("conv"), F.slice("turns", F.col("last"), 1).alias("answer"))
    j = t.join(answer, "conv", "left")
    before = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.col("last") - 1))
    other = F.when(F.pmod("conv", F.lit(2)) == 0, F.col("conv") + 1).otherwise(F.col("conv") - 1)
    return j.select(F.col("conv").alias("pair"), F.col("conv").alias("chosen_id"), other.alias("rejected_id"), F.col("turns").alias("a"), F.concat(before, F.coalesce("answer", F.array().cast(t.schema["turns"].dataType))).alias("b"))
