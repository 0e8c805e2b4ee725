"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Native: every step is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def _segments(turns: Column) -> Column:
    """Headers, which carry no loss, and bodies, which do where the assistant speaks."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(_header(t).alias("text"), F.lit(False).alias("loss")),
                F.struct(_body(t).alias("text"), (t["role"] == "assistant").alias("loss")),
            ),
        )
    )


def preferences(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen and rejected for each pair.

    turns: pair_id, side ('chosen' or 'rejected'), turn, role, text; other columns are ignored. The prompt is the longest
    run of first turns that have the same role and text on both sides, rendered once; the rest of either side is its
    completion, a list of segments (text, loss) in which only the assistant's own words carry loss. Null role and null
    text count as empty. Turns are ordered by turn, role and text, so that ties and repeated rows have one order. A pair
    with one side only has an empty completion on the other. Rows without pair_id, or of another side, are left out.
    """
    own = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(name: str) -> Column:
        held = F.sort_array(F.collect_list(F.when(F.col("side") == name, turn)))
        return F.transform(held, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)

    pairs = own.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    pairs = pairs.withColumn("_same", same)
    differ = F.array_position("_same", F.lit(False))
    pairs = pairs.withColumn("_n", F.when(differ > 0, differ - 1).otherwise(F.size("_same")).cast("int"))

    def rest(name: str) -> Column:
        return _segments(F.slice(name, F.col("_n") + 1, F.greatest(F.size(name) - F.col("_n"), F.lit(0)))).alias(name)

    prompt = F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("_n")), lambda t: F.concat(_header(t), _body(t))), "")
    return pairs.select("pair_id", F.col("_n").cast("long").alias("n_prompt_turns"), prompt.alias("prompt"), rest("chosen"), rest("rejected"))


def rendered(segments: str) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), "")
