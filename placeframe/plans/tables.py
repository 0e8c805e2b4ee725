"""Queries over tables: aggregates, windows, sets, schedules, feeds, text and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.functions import text
from placeframe.operators import feeds, quality, schedule
from placeframe.operators.rank import first_per
from placeframe.plans import views
from placeframe.plans.views import read, with_

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT p_brand, p_type, p_retailprice FROM part WHERE p_size > 20""")
def s1_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_size > 20").select("p_brand", "p_type", "p_retailprice")


@query(f"""{with_("cells")} SELECT city, count(*) AS areas, sum(pop)::BIGINT AS people, round(avg(road_strength), 6) AS road, round(sum(metro_access), 4) AS metro,
 count(nh_access) AS observed FROM cells GROUP BY city""")
def a1_mean_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cells(spark, sf_dir)
    return c.groupBy("city").agg(
        F.count(F.lit(1)).alias("areas"), F.sum("pop").alias("people"), F.round(F.avg("road_strength"), 6).alias("road"), F.round(F.sum("metro_access"), 4).alias("metro"), F.count("nh_access").alias("observed")
    )


@query("""WITH y AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) <= 1996) AS a, count(*) FILTER (year(o_orderdate) >= 1999) AS b FROM orders GROUP BY 1)
SELECT o_custkey AS cell, b - a AS growth FROM y WHERE a > 0 AND b > 0""")
def a2_growth_between_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"))
    y = o.agg(F.count_if(F.year("o_orderdate") <= 1996).alias("a"), F.count_if(F.year("o_orderdate") >= 1999).alias("b"))
    return y.where("a > 0 AND b > 0").select("cell", (F.col("b") - F.col("a")).alias("growth"))


@query(f"""{with_("cells")} SELECT coalesce(state, 'India') AS state, round(sum(CASE WHEN nh_access IS NOT NULL THEN pop END) / sum(pop)::DOUBLE, 6) AS nh_known,
 round(sum(CASE WHEN rail_access IS NOT NULL THEN pop END) / sum(pop)::DOUBLE, 6) AS rail_known FROM cells GROUP BY ROLLUP (state)""")
def a5_weighted_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c: F.round(F.sum(F.when(F.col(c).isNotNull(), F.col("pop"))) / F.sum("pop"), 6)
    return views.cells(spark, sf_dir).rollup("state").agg(known("nh_access").alias("nh_known"), known("rail_access").alias("rail_known")).withColumn("state", F.coalesce("state", F.lit("India")))


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS open, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS done FROM lineitem GROUP BY 1""")
def a6_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return out.withColumnsRenamed({"O": "open", "F": "done"})


@query("""SELECT coalesce(r_name, 'India') AS state, count(*) AS n, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS share
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name)""")
def a7_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount").join(s, "l_suppkey").join(n, "n_nationkey")
    share = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")
    return li.rollup("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("share")).select(F.coalesce("r_name", F.lit("India")).alias("state"), "n", "share")


@query(f"""{with_("cells")}, run AS (SELECT city, nh_access AS v, sum(pop) OVER (PARTITION BY city ORDER BY nh_access RANGE UNBOUNDED PRECEDING) AS run, sum(pop) OVER (PARTITION BY city) AS total
FROM cells WHERE nh_access IS NOT NULL) SELECT city, min(v) AS median FROM run WHERE 2 * run >= total GROUP BY city""")
def a8_lower_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.operators.score import lower_weighted_median

    return lower_weighted_median(views.cells(spark, sf_dir), ["city"], "nh_access", "pop")


@query(f"""{with_("cells")} SELECT coalesce(state, 'India') AS state, round(sum(pop * rail_access) / sum(CASE WHEN rail_access IS NOT NULL THEN pop END), 6) AS mean_km,
 round(sum(CASE WHEN rail_access <= 5 THEN pop ELSE 0 END) / sum(CASE WHEN rail_access IS NOT NULL THEN pop END)::DOUBLE, 6) AS within_5,
 sum(CASE WHEN rail_access > 10 THEN pop ELSE 0 END)::BIGINT AS beyond_10 FROM cells GROUP BY ROLLUP (state)""")
def a9_population_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop, km = F.col("pop"), F.col("rail_access")
    seen = F.sum(F.when(km.isNotNull(), pop))
    out = views.cells(spark, sf_dir).rollup("state").agg(
        F.round(F.sum(pop * km) / seen, 6).alias("mean_km"), F.round(F.sum(F.when(km <= 5, pop).otherwise(0)) / seen, 6).alias("within_5"), F.sum(F.when(km > 10, pop).otherwise(0)).alias("beyond_10")
    )
    return out.withColumn("state", F.coalesce("state", F.lit("India")))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(median(l_quantity), 4) AS med, round(stddev_pop(l_tax), 8) AS sd, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1""")
def a12_quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90"), F.round(F.median("l_quantity"), 4).alias("med"), F.round(F.stddev_pop("l_tax"), 8).alias("sd"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


_AS_OF = "2000-01-01"
_STATE_SQL = "CASE state WHEN 'Bihar, Odisha' THEN 'Multiple states' WHEN 'Kerala' THEN 'Kerala' WHEN 'orissa' THEN 'Odisha' WHEN 'J & K' THEN 'Jammu and Kashmir' WHEN 'Tamilnadu' THEN 'Tamil Nadu' END"
_FLAGS = f"""{with_("projects")}, d AS (SELECT *, {_STATE_SQL} AS st, try_strptime(appointed, '%d-%m-%Y')::DATE AS a0, try_strptime(scheduled, '%d-%m-%Y')::DATE AS s0, try_strptime(loa, '%d-%m-%Y')::DATE AS l0 FROM projects),
e AS (SELECT *, CASE WHEN year(a0) BETWEEN 1990 AND 2045 THEN a0 END AS a1, CASE WHEN year(s0) BETWEEN 1990 AND 2045 THEN s0 END AS s1, CASE WHEN year(l0) BETWEEN 1990 AND 2045 THEN l0 END AS l1,
 CASE stage WHEN 'Completed' THEN 'completed' WHEN 'Under Construction' THEN 'under_construction' WHEN 'Awarded' THEN 'awarded_not_started' WHEN 'Bidding' THEN 'bidding' ELSE 'unknown' END AS grp, try_cast(progress AS DOUBLE) AS pct, try_cast(cost AS DOUBLE) AS capex FROM d),
f AS (SELECT *, grp = 'under_construction' AS b, coalesce(grp = 'under_construction' AND s1 < a1, false) AS rev FROM e),
g AS (SELECT *, CASE WHEN NOT rev THEN s1 END AS s2 FROM f),
flags AS (SELECT id, st AS state, grp AS "group", CASE WHEN grp NOT IN ('under_construction', 'awarded_not_started') THEN 'not_applicable' WHEN grp = 'awarded_not_started' THEN 'not_started'
 WHEN s2 < DATE '{_AS_OF}' THEN 'overdue' WHEN s2 >= DATE '{_AS_OF}' THEN 'scheduled_ahead' ELSE 'unknown' END AS flag,
 CASE WHEN b AND s2 < DATE '{_AS_OF}' THEN DATE '{_AS_OF}' - s2 END AS days_overdue, CASE WHEN grp = 'awarded_not_started' THEN DATE '{_AS_OF}' - l1 END AS days_since_loa,
 CASE WHEN pct BETWEEN 0 AND 100 THEN pct END AS physical_pct, capex,
 concat_ws(';', CASE WHEN st IS NULL THEN 'unknown_state' END, CASE WHEN a0 IS NULL AND appointed IS NOT NULL THEN 'unparseable_appointed' END, CASE WHEN a0 IS NOT NULL AND a1 IS NULL THEN 'appointed_out_of_range' END,
 CASE WHEN s0 IS NULL AND scheduled IS NOT NULL THEN 'unparseable_scheduled' END, CASE WHEN s0 IS NOT NULL AND s1 IS NULL THEN 'scheduled_out_of_range' END,
 CASE WHEN l0 IS NULL AND loa IS NOT NULL THEN 'unparseable_loa' END, CASE WHEN l0 IS NOT NULL AND l1 IS NULL THEN 'loa_out_of_range' END,
 CASE WHEN pct IS NULL THEN 'unparseable_progress' END, CASE WHEN pct NOT BETWEEN 0 AND 100 THEN 'progress_out_of_range' END, CASE WHEN grp = 'unknown' THEN 'unknown_stage' END,
 CASE WHEN rev THEN 'scheduled_before_appointed' END, CASE WHEN b AND s1 IS NULL AND NOT rev THEN 'no_scheduled_date' END) AS reasons FROM g)"""


@query(f"{_FLAGS} SELECT * FROM flags")
def c12_project_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.flagged(views.projects(spark, sf_dir), _AS_OF)


@query(f"""{_FLAGS} SELECT CASE WHEN grouping(state) = 1 THEN 'India' ELSE state END AS state, count(*) FILTER (flag IN ('overdue', 'scheduled_ahead', 'unknown')) AS under_construction,
 count(*) FILTER (flag = 'overdue') AS overdue, count(*) FILTER (flag = 'scheduled_ahead') AS scheduled_ahead, count(*) FILTER (flag = 'not_started') AS not_started, count(*) FILTER (flag = 'unknown') AS unknown,
 median(CASE WHEN flag = 'overdue' THEN physical_pct END)::DOUBLE AS median_physical_pct_overdue, sum(CASE WHEN flag IN ('overdue', 'scheduled_ahead', 'unknown') THEN capex END) AS capex_under_construction,
 round(count(*) FILTER (flag = 'overdue') / nullif(count(*) FILTER (flag IN ('overdue', 'scheduled_ahead')), 0)::DOUBLE, 3) AS overdue_share,
 median(CASE WHEN flag = 'overdue' THEN days_overdue END)::DOUBLE AS median_days_overdue, median(CASE WHEN flag = 'not_started' THEN days_since_loa END)::DOUBLE AS median_days_since_loa,
 sum(CASE WHEN flag = 'overdue' THEN capex END) AS capex_overdue FROM flags WHERE flag <> 'not_applicable' GROUP BY ROLLUP (state) HAVING grouping(state) = 1 OR state IS NOT NULL""")
def a15_delay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.delays(schedule.flagged(views.projects(spark, sf_dir), _AS_OF))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def a16_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1 AND n >= 3""")
def a19_main_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("b")).select("user_id", "b.event_type", "b.n").where("n >= 3")


@query("""SELECT 'event_id' AS "column", count(*) AS rows, count(*) - count(event_id) AS nulls FROM events UNION ALL SELECT 'props', count(*), count(*) - count(props) FROM events
UNION ALL SELECT 'value', count(*), count(*) - count(value) FROM events""")
def a22_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_profile(read(spark, sf_dir, "events").select("event_id", "props", "value")).drop("share")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def a23_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) AS customers FROM customer GROUP BY 1""")
def a24_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.count(F.lit(1)).alias("customers"))


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS first_id, sum(count(*)) OVER (ORDER BY year(o_orderdate))::BIGINT AS so_far FROM orders GROUP BY year(o_orderdate)""")
def a32_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))
    return y.withColumn("so_far", F.sum("n").over(W.orderBy("year")))


@query("""SELECT user_id, event_type, CASE WHEN count(*) >= 5 THEN count(*) END AS n, count(*) < 5 AS suppressed FROM events GROUP BY 1, 2""")
def a34_small_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", "event_type", F.when(F.col("n") >= 5, F.col("n")).alias("n"), (F.col("n") < 5).alias("suppressed"))


@query("""SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def w4_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), "o_orderkey")


@query("""WITH t AS (SELECT quantile_cont(c_acctbal, 0.9) AS p90, quantile_cont(c_acctbal, 0.95) AS p95 FROM customer) SELECT c_custkey, CASE WHEN c_acctbal >= p95 THEN 'gap' WHEN c_acctbal >= p90 THEN 'wide' ELSE 'usual' END AS class FROM customer, t""")
def w12_percentile_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    t = c.agg(F.percentile("c_acctbal", 0.9).alias("p90"), F.percentile("c_acctbal", 0.95).alias("p95"))  # one row
    v = F.col("c_acctbal")
    return c.crossJoin(F.broadcast(t)).select("c_custkey", F.when(v >= F.col("p95"), "gap").when(v >= F.col("p90"), "wide").otherwise("usual").alias("class"))


@query(f"""{with_("points")} SELECT id FROM points, (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM points) WHERE lon < a + 0.1 * (b - a) OR lon > b - 0.1 * (b - a) OR lat < c + 0.1 * (d - c) OR lat > d - 0.1 * (d - c)""")
def w13_extent_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    box = p.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))  # one row
    edge = "lon < a + 0.1D * (b - a) OR lon > b - 0.1D * (b - a) OR lat < c + 0.1D * (d - c) OR lat > d - 0.1D * (d - c)"
    return p.crossJoin(F.broadcast(box)).where(edge).select("id")


@query("""SELECT c_nationkey AS k, 'customer' AS source, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_acctbal, NULL FROM supplier""")
def u1_union_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem""")
def u2_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("""SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30""")
def u3_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_partkey"))


@query("""SELECT k, sum(v)::BIGINT AS v FROM (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k""")
def u4_outer_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return c.unionAll(read(spark, sf_dir, "supplier").select("s_nationkey")).groupBy("k").agg(F.count(F.lit(1)).alias("v"))


@query("""SELECT user_id AS id, event_id AS record, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC, event_id DESC) = 1""")
def u5_upsert_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = first_per(read(spark, sf_dir, "events"), ["user_id"], F.desc(F.round("value")), F.desc("event_id"))
    return best.select(F.col("user_id").alias("id"), F.col("event_id").alias("record"), "event_type")


@query("""SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def j3_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left_anti")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, suppliers FROM a FULL JOIN b ON a.k = b.k""")
def j1_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = read(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), "suppliers")


@query(f"""{with_("targets")} SELECT a.id AS a, b.id AS b FROM targets a JOIN targets b ON a.id < b.id AND sqrt(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2)) BETWEEN 2 AND 4""")
def j16_distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.operators import spatial

    t = views.targets(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.pairs(t, 4.0, 2.0).select("a", "b")


_FEED = """e AS (SELECT *, user_id || '-' || strftime(ts, '%j') AS trip FROM events),
times AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'lost' ELSE trip END AS trip_id, (event_id % 50)::VARCHAR AS stop_id, row_number() OVER (PARTITION BY trip ORDER BY ts) AS stop_sequence, ts FROM e),
trips AS (SELECT DISTINCT trip AS trip_id, (user_id % 20)::VARCHAR AS route_id FROM e UNION ALL SELECT trip, 'gone' FROM e WHERE event_id % 499 = 0),
stops AS (SELECT DISTINCT (event_id % 48)::VARCHAR AS stop_id, CASE WHEN event_id % 48 = 7 THEN 'x' ELSE (70 + event_id % 48)::VARCHAR END AS stop_lon, (10 + event_id % 48 % 9)::VARCHAR AS stop_lat FROM events),
routes AS (SELECT DISTINCT (user_id % 21)::VARCHAR AS route_id FROM events UNION ALL SELECT 'idle')"""


def _feed(spark: SparkSession, sf_dir: str) -> feeds.Feed:
    e = read(spark, sf_dir, "events").withColumn("trip", F.concat_ws("-", "user_id", F.date_format("ts", "DDD")))
    seq = F.row_number().over(W.partitionBy("trip").orderBy("ts"))
    k = F.col("event_id") % 48
    return {
        "stop_times": e.select(F.when(F.col("event_id") % 97 == 0, "lost").otherwise(F.col("trip")).alias("trip_id"), (F.col("event_id") % 50).cast("string").alias("stop_id"), seq.cast("string").alias("stop_sequence"), "ts"),
        "trips": e.select(F.col("trip").alias("trip_id"), (F.col("user_id") % 20).cast("string").alias("route_id")).distinct().unionByName(e.where("event_id % 499 = 0").select(F.col("trip").alias("trip_id"), F.lit("gone").alias("route_id"))),
        "stops": e.select(k.cast("string").alias("stop_id"), F.when(k == 7, "x").otherwise((k + 70).cast("string")).alias("stop_lon"), (k % 9 + 10).cast("string").alias("stop_lat")).distinct(),
        "routes": e.select((F.col("user_id") % 21).cast("string").alias("route_id")).distinct().unionByName(spark.range(1).select(F.lit("idle").alias("route_id"))),
    }


_BOX = (68.0, 6.0, 98.0, 37.5)


@query(f"""WITH {_FEED}, i AS (SELECT 'error' AS level, 'duplicate_trip_id' AS "check", count(*) - count(DISTINCT trip_id) AS count FROM trips
UNION ALL SELECT 'error', 'duplicate_stop_id', count(*) - count(DISTINCT stop_id) FROM stops UNION ALL SELECT 'error', 'duplicate_route_id', count(*) - count(DISTINCT route_id) FROM routes
UNION ALL SELECT 'warning', 'stop_bad_coordinates', count(*) FROM stops WHERE NOT coalesce(try_cast(stop_lon AS DOUBLE) BETWEEN 68 AND 98 AND try_cast(stop_lat AS DOUBLE) BETWEEN 6 AND 37.5, false)
UNION ALL SELECT 'warning', 'trip_unknown_route', count(*) FROM trips WHERE route_id NOT IN (SELECT route_id FROM routes)
UNION ALL SELECT 'warning', 'stop_time_unknown_trip', count(*) FROM times WHERE trip_id NOT IN (SELECT trip_id FROM trips)
UNION ALL SELECT 'warning', 'stop_time_unknown_stop', count(*) FROM times WHERE stop_id NOT IN (SELECT stop_id FROM stops)
UNION ALL SELECT 'warning', 'route_without_trips', count(*) FROM routes WHERE route_id NOT IN (SELECT route_id FROM trips)) SELECT * FROM i WHERE count > 0""")
def v1_feed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.issues(_feed(spark, sf_dir), _BOX)


@query(f"""WITH {_FEED}, n AS (SELECT trip_id, count(*) AS n_stops FROM times GROUP BY 1)
SELECT route_id, trip_id, n_stops FROM (SELECT DISTINCT route_id, trip_id FROM trips) JOIN n USING (trip_id) QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n_stops DESC, trip_id) = 1""")
def w18_longest_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.longest_trips(_feed(spark, sf_dir))


@query(f"""WITH {_FEED}, n AS (SELECT trip_id, count(*) AS n_stops FROM times GROUP BY 1),
best AS (SELECT route_id, trip_id FROM (SELECT DISTINCT route_id, trip_id FROM trips) JOIN n USING (trip_id) QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n_stops DESC, trip_id) = 1)
SELECT route_id, string_agg(stop_id, ',' ORDER BY stop_sequence, stop_id) AS path FROM best JOIN times USING (trip_id) JOIN stops USING (stop_id) WHERE stop_lon <> 'x' AND try_cast(stop_lon AS DOUBLE) <= 98
GROUP BY route_id HAVING count(DISTINCT stop_lon || ' ' || stop_lat) >= 2""")
def w18_route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feeds.route_lines(_feed(spark, sf_dir), _BOX)
    return lines.select("route_id", F.array_join(F.transform("path", lambda p: p["stop_id"]), ",").alias("path"))


@query("""SELECT doc_id, regexp_replace(text, '\\d(?:[ -]?\\d){7,}', '[number]', 'g') AS text FROM documents WHERE regexp_matches(text, '\\d(?:[ -]?\\d){7,}')""")
def p35_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", text.redacted(F.col("text")).alias("r"))
    return d.where("text <> r").select("doc_id", F.col("r").alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Odisha' WHEN c_custkey % 4 = 1 THEN 'Jammu and Kashmir' WHEN c_custkey % 4 = 2 THEN 'Tamil Nadu' END AS state FROM customer""")
def p1_state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "ORISSA").when(k == 1, "J & K").when(k == 2, " Tamilnadu. ").otherwise("Atlantis")
    return read(spark, sf_dir, "customer").select("c_custkey", text.state(raw).alias("state"))


@query("""SELECT o_orderkey, (o_orderkey % 20) AS lanes_raw, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 16 THEN (o_orderkey % 20)::INT END AS lanes,
 CASE WHEN o_orderkey % 20 NOT BETWEEN 1 AND 16 THEN 'unknown' WHEN o_orderkey % 20 < 2 THEN '<2' WHEN o_orderkey % 20 <= 3 THEN '2' WHEN o_orderkey % 20 <= 5 THEN '4' ELSE '6+' END AS band FROM orders""")
def p4_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("o_orderkey") % 20
    n = text.lanes(F.concat(raw.cast("string"), F.lit(" Lanes")))
    return read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("lanes_raw"), n.alias("lanes"), text.lane_band(n).alias("band"))


@query("""SELECT o_orderkey, (1950 + o_orderkey % 91)::INT AS year, o_orderkey % 1000 AS cost FROM orders""")
def p8_p29_figures_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Rs. "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" crore, since "), (F.col("o_orderkey") % 91 + 1950).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.year(said).alias("year"), text.cost_crore(said).cast("long").alias("cost"))


@query("""SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE (json_extract_string(props, '$.k'))::BIGINT > 50""")
def p37_json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query("""SELECT page_id, 'news:page:' || page_id AS id, substring(sha1(url), 1, 8) AS short FROM pages""")
def p34_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.concat_ws(":", F.lit("news"), F.lit("page"), F.col("page_id")).alias("id"), F.substring(F.sha1("url"), 1, 8).alias("short"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, CASE WHEN count(*) >= 2 THEN count(*) END AS n FROM events GROUP BY 1, 2""")
def st4_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.streaming import jobs

    out = jobs.windowed_counts(read(spark, sf_dir, "events"), "user_id", "1 day", least=2)
    return out.select("user_id", F.col("start").alias("day"), "n")


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1""")
def st5_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.streaming import jobs

    return jobs.latest(read(spark, sf_dir, "events"), "user_id", ["event_type"])
