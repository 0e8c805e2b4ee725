"""Ranked lists, ties, reasons and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.functions import scoring as S
from placeframe.storage import table


def first_per(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a total order."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ranked(rows: DataFrame, by: list[str], limit: int, *order: Column | str) -> DataFrame:
    """The first `limit` rows of each group with rank, and total: how many the group holds."""
    w = W.partitionBy(*by)
    out = rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)})
    return out.where(F.col("rank") <= limit)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with their place, from 1, in a total order: places within ranges of the order behind the rows before them."""
    dealt = table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_before")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact quantiles of a column by their names, between two values in proportion; null where it has no value.

    Equal values are counted first, and counted on within ranges of the order, so that no task holds all values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = table(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("_n"))  # a row for each range
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    upto = F.sum("n").over(W.partitionBy("_part").orderBy("v")) + F.col("_before")
    placed = dealt.join(F.broadcast(before), "_part").withColumn("upto", upto)
    at = {k: (F.col("_all") - 1) * F.lit(share) for k, share in shares.items()}
    ends = [F.min(F.when(F.col("upto") > f(at[k]), F.col("v"))).alias(f"{k}_{i}") for k in shares for i, f in enumerate((F.floor, F.ceil))]
    one = placed.agg(F.max("_all").alias("_all"), *ends)
    between = lambda k: (F.ceil(at[k]) - at[k]) * F.col(f"{k}_0") + (at[k] - F.floor(at[k])) * F.col(f"{k}_1")
    return one.select(*[F.when(F.col(f"{k}_0") == F.col(f"{k}_1"), F.col(f"{k}_0").cast("double")).otherwise(between(k)).alias(k) for k in shares])


def competition_rank(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """rank: 1 + how many of the group score higher."""
    return rows.withColumn("rank", F.rank().over(W.partitionBy(*by).orderBy(F.desc(score))))


def reasons(base: DataFrame, others: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """keys, factor, delta, better for the largest differences each way.

    base(factor, sub) and others(*keys, factor, sub): a factor that either has not observed is left out.
    """
    both = others.join(base.withColumnRenamed("sub", "base"), "factor").where("sub IS NOT NULL AND base IS NOT NULL")
    both = both.withColumn("delta", S.delta(F.col("sub") - F.col("base"))).where("delta <> 0").withColumn("better", F.col("delta") > 0)
    w = W.partitionBy(*keys, "better").orderBy(F.desc(F.abs("delta")), "factor")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*keys, "factor", "delta", "better")


def plain(text: Column) -> Column:
    """Lower case, trimmed, white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def search(rows: DataFrame, text: str) -> DataFrame:
    """rows(id, name, aliases, people) whose name or alias holds the text, with matched and rank.

    Of a row's names the best match counts: a prefix before a substring, the own name before aliases in order.
    """
    text = " ".join(text.split()).lower()
    if not 2 <= len(text) <= 64:
        raise ValueError("search text has 2 to 64 characters")
    names = rows.select("id", "people", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "matched"))
    names = names.withColumn("_n", plain(F.col("matched"))).where(F.col("_n").contains(text))
    names = names.withColumn("prefix", F.col("_n").startswith(text))
    best = first_per(names, ["id"], F.desc("prefix"), "pos")
    return numbered(best, "rank", F.desc("prefix"), F.desc("people"), "id").select("id", "matched", "prefix", "people", "rank")
