"""Names that are alike: candidates by words and by pairs of letters, scores, and a choice in order without reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.functions.text import name_similarity, words_of
from placeframe.storage import release, table


def _grams(key: Column) -> Column:
    """Each two letters that follow each other, with their number: the first `an`, the second one, ..."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i), lambda h: h == g)).cast("string")))
    return F.when(F.length(key) >= 2, numbered).otherwise(F.array().cast("array<string>"))


def _parts(side: DataFrame, name: str) -> DataFrame:
    """kind, part: words (w) and numbered pairs of letters (g) of each side's keys; each key once for a state."""
    own = side.select("state", F.col("key").alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    w = F.transform(words_of(F.col(name)), lambda x: F.struct(F.lit("w").alias("kind"), x.alias("part")))
    g = F.transform(_grams(F.col(name)), lambda x: F.struct(F.lit("g").alias("kind"), x.alias("part")))
    return own.select("state", name, F.explode(F.concat(w, g)).alias("p")).select("state", name, "p.kind", "p.part")


def _places(parts: DataFrame, often: DataFrame, name: str, least: float) -> DataFrame:
    """state, name, kind, part, opening: the rarest word of each key, and those of its rarest pairs of letters of which a
    key of a score of `least` must have one, are its opening.

    With M letters in matching blocks of two keys of s letters, M >= least * s / 2, and there are at most s - 2 M + 1
    blocks, which hold M - blocks pairs of letters. As the other key can't be shorter than least / (2 - least) of this one,
    s is at least 2 / (2 - least) times its length.
    """
    counted = parts.join(often, ["state", "kind", "part"])
    order = F.array_sort(F.collect_list(F.struct("n", "part")))
    lists = counted.groupBy("state", name, "kind").agg(order.alias("parts"))
    shared = F.ceil(F.length(name) * 2 / (2 - least) * (1.5 * least - 1) - 1 - 1e-9)
    opening = F.when(F.col("kind") == "w", 1).otherwise(F.size("parts") - F.greatest(shared, F.lit(1)) + 1)
    return lists.select("state", name, "kind", F.posexplode("parts").alias("at", "p"), opening.alias("opening")).select("state", name, "kind", "p.part", (F.col("at") < F.col("opening")).alias("opening"))


def candidates(rows: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """state, key, ckey: of the keys of both sides' (key, state) in one state, each pair that may score `least` or more.

    None is lost that does: if all words of one key are in the other, its rarest is; if not, both openings of pairs of
    letters share one, or the keys are equal. Keys that are empty or null have no candidates. `least` is over 2 / 3, as
    below that matching blocks may be too short to share anything.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be over 2 / 3, up to 1")
    a, b = _parts(rows, "key"), _parts(codes, "ckey")
    both = a.select("state", "kind", "part").unionAll(b.select("state", "kind", "part"))
    often = table(both.groupBy("state", "kind", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    a, b = table(_places(a, often, "key", least), "places"), table(_places(b, often, "ckey", least).withColumnRenamed("opening", "copening"), "places")
    met = a.join(b, ["state", "kind", "part"])
    words = (F.col("kind") == "w") & (F.col("opening") | F.col("copening"))
    grams = (F.col("kind") == "g") & F.col("opening") & F.col("copening")
    equal = rows.select("state", "key").distinct().join(codes.select("state", F.col("key").alias("ckey")).distinct(), "state").where("key = ckey AND length(key) = 1")
    return met.where(words | grams).select("state", "key", "ckey").unionByName(equal.select("state", "key", "ckey")).distinct()


def matched(rows: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """id, code, score: each of rows(id, place, key, state), in the order of place, takes the best code not taken yet.

    codes(code, key, state). Ties of score go to the larger code, of place to the smaller id; rows or codes with an empty or
    null key, and null codes, are left out. Rows of one key share one list of codes, best first, so that no pairs of rows
    and codes are written: the first of a key asks for its list's first code, the second for its second, as each finds those
    before it taken. A code keeps the first in order, and the others of a key go on to places of the list that no row before
    them holds; nobody asks beyond what the walk in order gives, so what is left when nobody goes on is the walk's result.
    """
    group = ["state", "key"]
    near = candidates(rows, codes, least).withColumn("score", name_similarity(F.col("key"), F.col("ckey"))).where(F.col("score") >= least)
    near = table(near, "scores")
    there = codes.where("code IS NOT NULL").select("code", F.col("key").alias("ckey"), "state")
    best = near.join(there, ["state", "ckey"]).groupBy(*group, "code").agg(F.max("score").alias("score"))
    lists = table(best.withColumn("at", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), F.desc("code"))).cast("long")), "lists")
    release(near)
    asking = rows.select("id", "place", *group).join(lists.select(*group).distinct(), group)
    asking = asking.withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy("place", "id")).cast("long"))
    asking = table(asking.withColumn("at", F.col("n")), "asking")
    row, nowhere = F.struct("place", "id"), 1 << 40
    in_list = W.partitionBy(*group).orderBy("at")
    while True:
        asked = table(asking.join(lists, [*group, "at"]), "asked")
        release(asking)
        holder = table(asked.groupBy("code").agg(F.min(row).alias("h")), "holders")
        beaten = table(asked.join(holder, "code").where(row > F.col("h")).select(*group, "id", "place", "at"), "beaten")
        if beaten.isEmpty():
            return asked.select("id", "code", "score")
        first = beaten.groupBy(*group).agg(F.min(row).alias("f"), F.min("at").alias("after"))
        free = lists.join(first, group).where("at > after").join(holder, "code", "left").where("h IS NULL OR h > f")
        free = table(free.select(*group, "at", F.row_number().over(in_list).cast("long").alias("i")), "free")
        # the first free place behind each one's own, and behind that of the row before it
        both = beaten.select(*group, "at", "id", F.lit(0).alias("free")).unionByName(free.select(*group, "at", F.lit(None).cast("long").alias("id"), F.lit(1).alias("free")))
        at = F.sum("free").over(W.partitionBy(*group).orderBy("at", F.desc("free")).rowsBetween(W.unboundedPreceding, W.currentRow)) + 1
        going = both.withColumn("i", at).where("free = 0").withColumn("j", F.row_number().over(in_list))
        going = going.withColumn("i", F.col("j") + F.max(F.col("i") - F.col("j")).over(in_list))
        to = going.select(*group, "id", "i").join(free.withColumnRenamed("at", "to"), [*group, "i"], "left").select("id", F.coalesce("to", F.lit(nowhere)).alias("to"))
        moved = asked.join(to, "id", "left").select("id", "place", *group, "n", F.coalesce("to", "at").alias("at"))
        moved = moved.withColumn("at", F.col("n") + F.max(F.col("at") - F.col("n")).over(W.partitionBy(*group).orderBy("n")))
        asking = table(moved.where(F.col("at") < nowhere // 2), "asking")
        release(asked, holder, beaten, free)
