"""Rule tables: each check gives an issue row (level, check, count), and checks that find nothing give none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_rules(rows: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """level, check, count for rules (level, check, what a bad row meets): one pass over the rows for all."""
    counts = rows.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad) in enumerate(rules)])
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"), F.col(f"_{i}").alias("count")) for i, (level, name, _) in enumerate(rules)])
    return counts.select(F.explode(each).alias("r")).select("r.*").where("count > 0")


def issue(level: str, check: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("count")).select(F.lit(level).alias("level"), F.lit(check).alias("check"), "count").where("count > 0")


def duplicates(rows: DataFrame, key: str, level: str = "error") -> DataFrame:
    """Rows beyond the first of each key."""
    extra = rows.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("count"))
    return extra.select(F.lit(level).alias("level"), F.lit(f"duplicate_{key}").alias("check"), "count").where("count > 0")


def orphans(rows: DataFrame, key: str, others: DataFrame, check: str, level: str = "warning") -> DataFrame:
    """Rows whose key is not among the others'."""
    return issue(level, check, rows.join(others.select(key).distinct(), key, "left_anti"))


def all_of(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def null_profile(rows: DataFrame) -> DataFrame:
    """column, rows, nulls, share: one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(c))]
    return counts.select("rows", F.explode(F.create_map(*pairs)).alias("column", "nulls")).withColumn("share", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")))
