"""Stand-in views: the library's input tables made from the given ones, for Spark and, as text, for DuckDB.

All arithmetic is on integers or exact, so that both engines build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(key: str, by: int, modulo: int, least: int) -> F.Column:
    return F.lit(float(least)) + (F.col(key) * F.lit(by) % F.lit(modulo)) / F.lit(1000.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, w: places with people, from customer."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        spread("c_custkey", 7919, 30000, 68).alias("lon"),
        spread("c_custkey", 10473, 31500, 6).alias("lat"),
        (F.col("c_custkey") * 37 % 5000 + 1).alias("w"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, kind: stations and plazas, from supplier."""
    s = read(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        spread("s_suppkey", 9311, 30000, 68).alias("lon"),
        spread("s_suppkey", 6337, 31500, 6).alias("lat"),
        F.when(F.col("s_nationkey") % 2 == 0, "rail").otherwise("metro").alias("kind"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, city, state, pop and the raw value of each factor (null for some): areas, from customer and its orders."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"),
        F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"),
    )
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("r_regionkey"))
    r = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("state"))
    c = read(spark, sf_dir, "customer").join(o, "c_custkey", "left").join(n, "c_nationkey").join(r, "r_regionkey")
    key = F.col("c_custkey")
    return c.select(
        key.alias("cell"),
        "city",
        "state",
        (key * 37 % 5000 + 1).alias("pop"),
        F.when(key % 9 != 0, F.col("n") * 1.0).alias("nh_access"),
        F.when(key % 11 != 0, (key * 53 % 1700) / F.lit(100.0)).alias("rail_access"),
        F.when(F.col("days") >= 2, F.col("days") / F.lit(200.0)).alias("metro_access"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / F.lit(3000.0)).alias("road_strength"),
        (F.col("urgent") * F.lit(15.0) / F.col("n")).alias("built_up_growth"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, cell: areas of each city; every seventh area serves the next city too."""
    names = read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 25).alias("_k"), F.col("n_name").alias("city"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), "c_nationkey")
    own = c.select("cell", F.col("c_nationkey").alias("_k"))
    shared = c.where("cell % 7 = 0").select("cell", ((F.col("c_nationkey") + 1) % 25).alias("_k"))
    return own.unionByName(shared).join(F.broadcast(names), "_k").select("city", "cell")


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id, lon, lat: ordered nodes of ways, from lineitem."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(order).alias("pos"))
    return li.select(
        F.col("l_orderkey").alias("way_id"),
        "pos",
        F.col("l_partkey").alias("node_id"),
        spread("l_partkey", 7919, 30000, 68).alias("lon"),
        spread("l_partkey", 10473, 31500, 6).alias("lat"),
    )


def way_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: consecutive different nodes of the ways, told in the order of way_nodes() without a second one."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"))
    return li.where("b IS NOT NULL AND a <> b")


def street_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id, lon, lat: short streets in neighbourhoods of four, with ends of their own, from lineitem."""
    # a way's nodes are told by their number alone, so its rows are counted, not put in order
    ways = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    ways = ways.select("way_id", F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    block = F.floor(F.col("way_id") / 16)
    at = F.col("way_id") * 7 % 23 + F.col("pos") * (F.col("way_id") % 3 + 1)
    node = (block * 100 + at % 40).cast("long")
    lon = F.lit(68.0) + (block * 7919 % 30000) / F.lit(1000.0) + node % 11 / F.lit(64.0)
    lat = F.lit(6.0) + (block * 10473 % 31500) / F.lit(1000.0) + node % 5 / F.lit(64.0)
    return ways.select("way_id", "pos", node.alias("node_id"), lon.alias("lon"), lat.alias("lat"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project schedules as text columns, some unreadable or out of range, from orders."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def date(days: F.Column, odd: int) -> F.Column:
        text = F.date_format(F.date_add(F.to_date("o_orderdate"), days.cast("int")), "dd-MM-yyyy")
        return F.when(key % 11 == odd, F.lit("n/a")).when(key % 13 == odd, F.lit("01-01-1955")).otherwise(text)

    stage = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Under Construction")
    stage = stage.when(F.col("o_orderpriority") == "3-MEDIUM", "Awarded").when(F.col("o_orderpriority") == "5-LOW", "Bidding")
    states = F.when(key % 17 == 0, "Bihar, Odisha").when(key % 19 == 0, "Nowhere").when(key % 5 == 0, "Kerala").when(key % 5 == 1, "orissa").when(key % 5 == 2, "J & K").otherwise("Tamilnadu")
    return o.select(
        key.alias("id"),
        states.alias("state"),
        stage.alias("stage"),
        date(key * 0, 3).alias("appointed"),
        date(key * 7 % 900 - 20, 4).alias("scheduled"),
        date(-(key * 0) - 90, 5).alias("loa"),
        F.when(key % 23 == 0, "x").otherwise((key * 31 % 120).cast("string")).alias("progress"),
        F.when(key % 29 == 0, "-").otherwise((key * 13 % 997).cast("string")).alias("cost"),
    )


#: The same views in DuckDB's SQL, for use behind WITH.
SQL = {
    "points": """points AS (SELECT c_custkey AS id, 68 + (c_custkey * 7919 % 30000) / 1000.0::DOUBLE AS lon,
  6 + (c_custkey * 10473 % 31500) / 1000.0::DOUBLE AS lat, c_custkey * 37 % 5000 + 1 AS w FROM customer)""",
    "targets": """targets AS (SELECT s_suppkey AS id, 68 + (s_suppkey * 9311 % 30000) / 1000.0::DOUBLE AS lon,
  6 + (s_suppkey * 6337 % 31500) / 1000.0::DOUBLE AS lat, CASE WHEN s_nationkey % 2 = 0 THEN 'rail' ELSE 'metro' END AS kind FROM supplier)""",
    "cells": """cells AS (SELECT c_custkey AS cell, n_name AS city, r_name AS state, c_custkey * 37 % 5000 + 1 AS pop,
  CASE WHEN c_custkey % 9 <> 0 THEN n::DOUBLE END AS nh_access,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 53 % 1700) / 100.0::DOUBLE END AS rail_access,
  CASE WHEN days >= 2 THEN days / 200.0::DOUBLE END AS metro_access,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 3000.0::DOUBLE END AS road_strength,
  urgent * 15.0::DOUBLE / n AS built_up_growth
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days,
             count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON o_custkey = c_custkey)""",
    "members": """members AS (SELECT n_name AS city, c_custkey AS cell FROM customer JOIN nation
  ON n_nationkey = c_nationkey OR (c_custkey % 7 = 0 AND n_nationkey = (c_nationkey + 1) % 25))""",
    "way_nodes": """way_nodes AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos, l_partkey AS node_id,
  68 + (l_partkey * 7919 % 30000) / 1000.0::DOUBLE AS lon, 6 + (l_partkey * 10473 % 31500) / 1000.0::DOUBLE AS lat FROM lineitem)""",
}
SQL["street_nodes"] = (
    SQL["way_nodes"]
    + """, street_nodes AS (SELECT way_id, pos, node_id, 68 + (way_id // 16 * 7919 % 30000) / 1000.0::DOUBLE + node_id % 11 / 64.0::DOUBLE AS lon,
  6 + (way_id // 16 * 10473 % 31500) / 1000.0::DOUBLE + node_id % 5 / 64.0::DOUBLE AS lat
  FROM (SELECT way_id, pos, (way_id // 16 * 100 + (way_id * 7 % 23 + pos * (way_id % 3 + 1)) % 40)::BIGINT AS node_id FROM way_nodes))"""
)
_date = """CASE WHEN o_orderkey % 11 = {0} THEN 'n/a' WHEN o_orderkey % 13 = {0} THEN '01-01-1955'
  ELSE strftime(o_orderdate::DATE + ({1})::INTEGER, '%d-%m-%Y') END"""
SQL["projects"] = f"""projects AS (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Bihar, Odisha' WHEN o_orderkey % 19 = 0 THEN 'Nowhere' WHEN o_orderkey % 5 = 0 THEN 'Kerala'
       WHEN o_orderkey % 5 = 1 THEN 'orissa' WHEN o_orderkey % 5 = 2 THEN 'J & K' ELSE 'Tamilnadu' END AS state,
  CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Under Construction'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Awarded' WHEN o_orderpriority = '5-LOW' THEN 'Bidding' END AS stage,
  {_date.format(3, "0")} AS appointed, {_date.format(4, "o_orderkey * 7 % 900 - 20")} AS scheduled, {_date.format(5, "-90")} AS loa,
  CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE (o_orderkey * 31 % 120)::VARCHAR END AS progress,
  CASE WHEN o_orderkey % 29 = 0 THEN '-' ELSE (o_orderkey * 13 % 997)::VARCHAR END AS cost FROM orders)"""


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
