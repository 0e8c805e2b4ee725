"""Queries that hold spoiled tables against contracts: each rule finds its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.operators import contracts as C
from placeframe.operators.quality import all_of
from placeframe.plans.views import read

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, cell, pop, cov: areas, from customer; some are spoiled in one way each."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.when(k % 73 == 0, 999).otherwise(F.col("c_nationkey")).cast("long").alias("city"),
        F.when(k % 97 == 5, k - 1).otherwise(k).cast("long").alias("cell"),
        F.when(k % 89 == 0, -1).when(k % 83 != 0, k * 37 % 5000 + 1).cast("long").alias("pop"),
        F.when(k % 79 == 0, 1.5).when(k % 61 == 0, float("nan")).otherwise((k % 10 + 1) / F.lit(10.0)).alias("cov"),
    )


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, state, population, cells, tier, best: cities with the numbers of their areas, some spoiled."""
    per = _areas(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("pop", F.lit(0))).alias("people"), F.min("cell").alias("first"))
    n = read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long")).join(per, F.col("k") == F.col("city"), "left")
    tier = F.when(F.col("people") >= 150000, "metro").when(F.col("people") >= 120000, "large").otherwise("mid")
    return n.select(
        F.col("k").alias("id"),
        F.when(F.col("k") == 17, " ").otherwise(F.trim("n_name")).alias("name"),
        F.when(F.col("k") == 13, 77).otherwise(F.col("n_regionkey")).cast("long").alias("state"),
        F.col("people").alias("population"),
        F.when(F.col("k") == 7, F.col("n") + 1).otherwise(F.col("n")).alias("cells"),
        F.when(F.col("k") == 11, "tiny").when(F.col("k") == 12, "metro").otherwise(tier).alias("tier"),
        F.when(F.col("k") == 19, -5).otherwise(F.col("first")).alias("best"),
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, city_count, note: states with the numbers of their cities, one wrong."""
    per = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    r = read(spark, sf_dir, "region").join(per, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_regionkey").cast("long").alias("code"), F.when(F.col("r_regionkey") == 2, 1).otherwise(F.col("n")).cast("long").alias("city_count"), F.col("r_name").alias("note"))


#: What a set of published tables must keep to.
PUBLISHED = {
    "states": C.Table((C.Field("code", "bigint"), C.Field("city_count", "bigint", least=1)), unique=(("code",),), counts=(C.Count("city_count", "code", "cities", "state"),)),
    "cities": C.Table(
        (
            C.Field("id", "bigint"), C.Field("name", "string", text=True), C.Field("state", "bigint"), C.Field("population", "bigint", least=1),
            C.Field("cells", "bigint", least=1), C.Field("tier", "string", among=("metro", "large", "mid")), C.Field("best", "bigint"),
        ),
        unique=(("id",),),
        derived={"tier": "CASE WHEN population >= 150000 THEN 'metro' WHEN population >= 120000 THEN 'large' ELSE 'mid' END"},
        references=(C.Reference(("state",), "states", ("code",)), C.Reference(("id", "best"), "areas", ("city", "cell")), C.Reference(("id",), "areas", ("city",), "warning")),
        counts=(C.Count("cells", "id", "areas", "city"),),
        rows=(1, 1000),
    ),
    "areas": C.Table(
        (C.Field("city", "bigint"), C.Field("cell", "bigint"), C.Field("pop", "bigint", least=0), C.Field("cov", "double", least=0.0, most=1.0), C.Field("conf", "double")),
        unique=(("city", "cell"), ("cell",)),
        references=(C.Reference(("city",), "cities", ("id",)),),
    ),
    "assets": C.Table((C.Field("city"),)),
}

_SPOILED = """WITH areas AS (SELECT CASE WHEN c_custkey % 73 = 0 THEN 999 ELSE c_nationkey END AS city, CASE WHEN c_custkey % 97 = 5 THEN c_custkey - 1 ELSE c_custkey END AS cell,
 CASE WHEN c_custkey % 89 = 0 THEN -1 WHEN c_custkey % 83 <> 0 THEN c_custkey * 37 % 5000 + 1 END AS pop, c_custkey % 79 = 0 OR c_custkey % 61 = 0 AS over, c_custkey % 79 <> 0 AND c_custkey % 61 = 0 AS under FROM customer),
per AS (SELECT city, count(*) AS n, sum(CASE WHEN pop >= 0 THEN pop ELSE 0 END) AS people, min(cell) AS first FROM areas GROUP BY 1),
cities AS (SELECT n_nationkey AS id, n_nationkey = 17 AS blank, CASE WHEN n_nationkey = 13 THEN 77 ELSE n_regionkey END AS state, people, CASE WHEN n_nationkey = 7 THEN n + 1 ELSE n END AS cells, n,
 CASE WHEN people >= 150000 THEN 'metro' WHEN people >= 120000 THEN 'large' ELSE 'mid' END AS want, CASE WHEN n_nationkey = 19 THEN -5 ELSE first END AS best FROM nation LEFT JOIN per ON n_nationkey = city),
tiers AS (SELECT *, CASE WHEN id = 11 THEN 'tiny' WHEN id = 12 THEN 'metro' ELSE want END AS tier FROM cities),
states AS (SELECT r_regionkey AS code, CASE WHEN r_regionkey = 2 THEN 1 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS city_count FROM region)
"""


def _union(*issues: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{level}' AS level, '{table}' AS "table", '{check}' AS "check", n::BIGINT AS count FROM (SELECT {what}) q(n) WHERE n > 0""" for level, table, check, what in issues)


_ISSUES = _union(
    ("error", "assets", "missing_table", "1"),
    ("error", "states", "unknown:note", "1"),
    ("error", "areas", "missing:conf", "1"),
    ("error", "states", "count:city_count", "count(*) FROM states WHERE city_count <> (SELECT count(*) FROM cities WHERE state = code)"),
    ("error", "cities", "blank:name", "count(*) FROM cities WHERE blank"),
    ("error", "cities", "null:population", "count(*) FROM cities WHERE people IS NULL"),
    ("error", "cities", "null:cells", "count(*) FROM cities WHERE cells IS NULL"),
    ("error", "cities", "null:best", "count(*) FROM cities WHERE best IS NULL"),
    ("error", "cities", "unlisted:tier", "count(*) FROM tiers WHERE tier = 'tiny'"),
    ("error", "cities", "derived:tier", "count(*) FROM tiers WHERE tier <> want"),
    ("error", "cities", "unresolved:state", "count(*) FROM cities WHERE state NOT IN (SELECT code FROM states)"),
    ("error", "cities", "unresolved:id,best", "count(*) FROM cities WHERE best IS NOT NULL AND NOT EXISTS (SELECT 1 FROM areas WHERE city = id AND cell = best)"),
    ("warning", "cities", "unresolved:id", "count(*) FROM cities WHERE id NOT IN (SELECT city FROM areas)"),
    ("error", "cities", "count:cells", "count(*) FROM cities WHERE cells IS DISTINCT FROM coalesce(n, 0)"),
    ("error", "areas", "null:pop", "count(*) FROM areas WHERE pop IS NULL"),
    ("error", "areas", "below:pop", "count(*) FROM areas WHERE pop < 0"),
    ("error", "areas", "above:cov", "count(*) FROM areas WHERE over"),
    ("error", "areas", "below:cov", "count(*) FROM areas WHERE under"),
    ("error", "areas", "repeated:city,cell", "sum(n - 1) FROM (SELECT count(*) AS n FROM areas GROUP BY city, cell)"),
    ("error", "areas", "repeated:cell", "sum(n - 1) FROM (SELECT count(*) AS n FROM areas GROUP BY cell)"),
    ("error", "areas", "unresolved:city", "count(*) FROM areas WHERE city NOT IN (SELECT id FROM cities)"),
)


@query(_SPOILED + _ISSUES)
def v5_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published states, cities and areas, spoiled in many ways, against the contract of all three."""
    tables = {"states": _states(spark, sf_dir), "cities": _cities(spark, sf_dir), "areas": _areas(spark, sf_dir)}
    return C.check(spark, tables, PUBLISHED)


_KEYS = [("stops", "part", "p_partkey", ("p_partkey",)), ("trips", "orders", "o_orderkey", ("o_orderkey",)), ("stop_times", "lineitem", "l_orderkey, l_linenumber", ("l_orderkey", "l_linenumber")), ("calls", "lineitem", "l_orderkey, l_partkey", ("l_orderkey", "l_partkey"))]


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "table", '{k.replace(" ", "")}' AS key, count(*) AS rows, count(DISTINCT ({k})) AS "distinct", round(100.0 * count(DISTINCT ({k})) / count(*), 4) AS distinct_pct, count(*) - count(DISTINCT ({k})) AS repeated, 0 AS nulls FROM {t}""" for n, t, k, _ in _KEYS))
def v2_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four keys that should be unique: rows, different keys, their share, rows beyond the first and nulls."""
    return all_of(*[C.key_profile(read(spark, sf_dir, t), name, key) for name, t, _, key in _KEYS])


#: What tables of wards and bodies must keep to: codes are errors, wards that nothing refers to only warn.
GEOGRAPHY = {
    "bodies": C.Table(
        (C.Field("id", "bigint"), C.Field("state", "bigint"), C.Field("census_code")),
        closed=False, unique=(("id",),),
        references=(C.Reference(("state",), "states", ("code",)), C.Reference(("id",), "wards", ("body",), "warning")),
    ),
    "wards": C.Table((C.Field("ward", "bigint"), C.Field("body", "bigint")), closed=False, references=(C.Reference(("body",), "bodies", ("id",), "warning"),)),
}


@query("""WITH bodies AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 101 <> 0 THEN CASE WHEN c_custkey % 103 = 0 THEN 99 ELSE c_nationkey END END AS state FROM customer),
wards AS (SELECT o_orderkey AS ward, CASE WHEN o_orderkey % 107 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 109 = 0 THEN 100000000 ELSE 0 END END AS body FROM orders) """ + _union(
    ("error", "bodies", "missing:census_code", "1"),
    ("error", "bodies", "null:state", "count(*) FROM bodies WHERE state IS NULL"),
    ("error", "bodies", "unresolved:state", "count(*) FROM bodies WHERE state NOT IN (SELECT n_nationkey FROM nation)"),
    ("warning", "bodies", "unresolved:id", "count(*) FROM bodies WHERE NOT EXISTS (SELECT 1 FROM wards WHERE body = id)"),
    ("error", "wards", "null:body", "count(*) FROM wards WHERE body IS NULL"),
    ("warning", "wards", "unresolved:body", "count(*) FROM wards WHERE body IS NOT NULL AND body NOT IN (SELECT id FROM bodies)"),
))
def v4_geography_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with null and unknown states and without a code column; wards with null and unknown bodies."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    state = F.when(k % 101 != 0, F.when(k % 103 == 0, 99).otherwise(F.col("c_nationkey"))).cast("long")
    body = F.when(o % 107 != 0, F.col("o_custkey") + F.when(o % 109 == 0, 100000000).otherwise(0)).cast("long")
    tables = {
        "bodies": read(spark, sf_dir, "customer").select(k.cast("long").alias("id"), state.alias("state")),
        "wards": read(spark, sf_dir, "orders").select(o.cast("long").alias("ward"), body.alias("body")),
        "states": read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code")),
    }
    return C.check(spark, tables, GEOGRAPHY)


#: What an export asks of its inputs.
EXPORT = {
    "cities": C.Table((C.Field("id", "bigint"), C.Field("state", "bigint"), C.Field("lon", "double")), closed=False, unique=(("id",),), references=(C.Reference(("state",), "states", ("code",)), C.Reference(("id",), "memberships", ("city_id",)))),
    "cells": C.Table((C.Field("cell", "bigint"), C.Field("pop", "bigint", least=500)), closed=False, unique=(("cell",),)),
    "memberships": C.Table((C.Field("city_id", "bigint"), C.Field("cell", "bigint")), references=(C.Reference(("city_id",), "cities", ("id",)), C.Reference(("cell",), "cells", ("cell",)))),
}


@query("""WITH cities AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 50 ELSE n_regionkey END AS state FROM nation UNION ALL SELECT 4, 0 UNION ALL SELECT 900, 1),
cells AS (SELECT CASE WHEN c_custkey % 113 = 2 THEN c_custkey - 1 ELSE c_custkey END AS cell, c_custkey * 37 % 5000 + 1 AS pop FROM customer),
m AS (SELECT CASE WHEN c_custkey % 127 = 0 THEN 901 ELSE c_nationkey END AS city_id, c_custkey AS cell FROM customer) """ + _union(
    ("error", "cities", "missing:lon", "1"),
    ("error", "cities", "repeated:id", "sum(n - 1) FROM (SELECT count(*) AS n FROM cities GROUP BY id)"),
    ("error", "cities", "unresolved:state", "count(*) FROM cities WHERE state NOT IN (SELECT r_regionkey FROM region)"),
    ("error", "cities", "unresolved:id", "count(*) FROM cities WHERE id NOT IN (SELECT city_id FROM m)"),
    ("error", "cells", "below:pop", "count(*) FROM cells WHERE pop < 500"),
    ("error", "cells", "repeated:cell", "sum(n - 1) FROM (SELECT count(*) AS n FROM cells GROUP BY cell)"),
    ("error", "memberships", "unresolved:city_id", "count(*) FROM m WHERE city_id NOT IN (SELECT id FROM cities)"),
    ("error", "memberships", "unresolved:cell", "count(*) FROM m WHERE cell NOT IN (SELECT cell FROM cells)"),
))
def v6_export_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing columns, duplicates, unknown states, members of unknown cities or without facts, cities without cells, few people."""
    k = F.col("c_custkey")
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    more = spark.createDataFrame([(4, 0), (900, 1)], "id long, state long")
    tables = {
        "cities": n.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") == 3, 50).otherwise(F.col("n_regionkey")).cast("long").alias("state")).unionByName(more),
        "cells": c.select(F.when(k % 113 == 2, k - 1).otherwise(k).cast("long").alias("cell"), (k * 37 % 5000 + 1).cast("long").alias("pop")),
        "memberships": c.select(F.when(k % 127 == 0, 901).otherwise(F.col("c_nationkey")).cast("long").alias("city_id"), k.cast("long").alias("cell")),
        "states": read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("code")),
    }
    return C.check(spark, tables, EXPORT)
