"""Queries that compose operators: joins by cell and name, scores of text items, densities, anchors and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.functions import geo, text
from placeframe.functions import scoring as S
from placeframe.operators import quality
from placeframe.operators.mentions import mentions
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


_NODES = f"""{with_("way_nodes")}, n AS (SELECT *, count(*) OVER (PARTITION BY node_id) AS shared, pos = 1 AS is_first, pos = max(pos) OVER (PARTITION BY way_id) AS is_last FROM way_nodes),
cut AS (SELECT way_id, pos, node_id FROM n WHERE shared >= 2 OR is_first OR is_last)"""


@query(f"""{_NODES}, e AS (SELECT way_id, pos AS start, node_id AS u, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS v FROM cut) SELECT * FROM e WHERE v IS NOT NULL""")
def w6_junction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut into edges at their ends and at nodes used twice or more."""
    return _cut(views.way_nodes(spark, sf_dir), 2)


@query(f"""SELECT way_id, count(*) AS edges FROM ({SQL["w6_junction_edges"]}) GROUP BY 1""")
def w6_junction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges each way is cut into."""
    return w6_junction_edges(spark, sf_dir).groupBy("way_id").agg(F.count(F.lit(1)).alias("edges"))


def _cut(nodes: DataFrame, least: int) -> DataFrame:
    busy = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    way = W.partitionBy("way_id")
    cut = nodes.join(busy, "node_id", "left").withColumn("last", F.max("pos").over(way)).where("shared IS NOT NULL OR pos = 1 OR pos = last")
    edges = cut.select("way_id", F.col("pos").alias("start"), F.col("node_id").alias("u"), F.lead("node_id").over(way.orderBy("pos")).alias("v"))
    return edges.where("v IS NOT NULL")


@query("""WITH w AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS refs FROM orders GROUP BY 1) SELECT o_custkey AS way_id, i AS pos, refs[i] AS node_id FROM w, unnest(range(1, len(refs) + 1)) AS r(i)""")
def s11_unnest_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("way_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("refs"))
    return ways.select("way_id", F.posexplode("refs").alias("pos", "node_id")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query(f"""{with_("points")}, g AS (SELECT floor(lon / 2)::BIGINT AS cx, floor(lat / 2)::BIGINT AS cy, sum(w) AS people FROM points GROUP BY 1, 2) SELECT cx, cy, people::BIGINT AS people, round(people / 4.0::DOUBLE, 4) AS density, round(100000.0::DOUBLE / people, 4) AS per_lakh FROM g""")
def a3_a11_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir).groupBy(F.floor(F.col("lon") / 2).alias("cx"), F.floor(F.col("lat") / 2).alias("cy")).agg(F.sum("w").alias("people"))
    return p.select("cx", "cy", "people", F.round(F.col("people") / 4.0, 4).alias("density"), F.round(F.lit(100000.0) / F.col("people"), 4).alias("per_lakh"))


@query("""WITH b AS (SELECT l_returnflag, median(l_extendedprice / l_quantity) AS m FROM lineitem GROUP BY 1), z AS (SELECT m FROM b WHERE l_returnflag = 'N')
SELECT l_returnflag, round(b.m / z.m, 6) AS ratio, abs(b.m / z.m - 1) <= 0.05 AS as_expected FROM b, z""")
def a18_ratio_to_base_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("m"))
    base = m.where("l_returnflag = 'N'").select(F.col("m").alias("base"))  # one row
    ratio = F.col("m") / F.col("base")
    return m.crossJoin(F.broadcast(base)).select("l_returnflag", F.round(ratio, 6).alias("ratio"), (F.abs(ratio - 1) <= 0.05).alias("as_expected"))


@query("""WITH t AS (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS trips, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM t GROUP BY 1""")
def a25_feed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("trips"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""SELECT n_name AS city, c_mktsegment AS kind, count(*) AS buses FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, n_name, c_mktsegment) <= 10""")
def a26_fleet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    c = read(spark, sf_dir, "customer").join(n, "c_nationkey").groupBy("city", F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("buses"))
    return c.orderBy(F.desc("buses"), "city", "kind").limit(10)


@query("""SELECT o_orderkey, abs(o_totalprice - coalesce(s, 0)) > 1 AS differs FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def a30_a31_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(parts, "o_orderkey", "left")
    return o.select("o_orderkey", (F.abs(F.col("o_totalprice") - F.coalesce("s", F.lit(0.0))) > 1).alias("differs"))


@query("""SELECT strftime(max(ts), '%Y-%m-%d') AS as_of, count(*) AS rows FROM events""")
def a35_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("as_of"), F.count(F.lit(1)).alias("rows"))


@query("""WITH c AS (SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'events', count(*) FROM events WHERE value < 0 UNION ALL SELECT 'suppliers', count(*) FROM supplier WHERE s_acctbal > 9000)
SELECT part, n, CASE WHEN n = 0 THEN 'UNAVAILABLE' WHEN n < 100 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM c""")
def a37_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"orders": ("orders", "o_orderstatus = 'P'"), "events": ("events", "value < 0"), "suppliers": ("supplier", "s_acctbal > 9000")}
    counts = [read(spark, sf_dir, t).where(w).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p, (t, w) in parts.items()]
    return quality.all_of(*counts).withColumn("status", F.when(F.col("n") == 0, "UNAVAILABLE").when(F.col("n") < 100, "PARTIAL").otherwise("COMPLETE"))


@query(f"""{with_("points", "targets")}, t AS (SELECT DISTINCT floor(lon) AS cx, floor(lat) AS cy FROM targets) SELECT id FROM points JOIN t ON floor(lon) = cx AND floor(lat) = cy""")
def j10_same_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = [F.floor("lon").alias("cx"), F.floor("lat").alias("cy")]
    return views.points(spark, sf_dir).select("id", *cell).join(views.targets(spark, sf_dir).select(*cell).distinct(), ["cx", "cy"], "left_semi").select("id")


@query("""WITH f AS (SELECT p_type AS k, arg_min(p_brand, p_partkey) AS brand FROM part WHERE p_size < 10 GROUP BY 1) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, brand) AS brand FROM part LEFT JOIN f ON k = p_type""")
def j12_fill_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    fill = p.where("p_size < 10").groupBy("p_type").agg(F.min_by("p_brand", "p_partkey").alias("brand"))
    own = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    return p.join(fill, "p_type", "left").select("p_partkey", F.coalesce(own, "brand").alias("brand"))


@query(r"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT name, unnest(list_concat([name], string_split(name, ' '))) AS said FROM n)
SELECT DISTINCT p_partkey, name FROM part JOIN a ON regexp_matches(p_name, '(?i)\b' || regexp_escape(said) || '\b')""")
def j14_name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that a text mentions whole or by one of its aliases."""
    p = read(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("name"), F.split("p_name", " ").alias("aliases")).distinct()
    return mentions(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), names).withColumnRenamed("id", "p_partkey")


@query(f"""SELECT p_partkey, count(*) AS names FROM ({SQL["j14_name_mentions"]}) GROUP BY 1""")
def j14_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each text mentions."""
    return j14_name_mentions(spark, sf_dir).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("names"))


@query(f"""{with_("points", "targets")}, c AS (SELECT id, floor(lon / 0.25) AS cx, floor(lat / 0.25) AS cy FROM points) SELECT DISTINCT c.id FROM c JOIN targets t ON abs(cx - floor(t.lon / 0.25)) <= 4 AND abs(cy - floor(t.lat / 0.25)) <= 4""")
def j19_pixels_near_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-4, 5) for j in range(-4, 5)])
    px = [F.floor(F.col(c) / 0.25).alias(n) for c, n in (("lon", "cx"), ("lat", "cy"))]
    near = views.targets(spark, sf_dir).select(*px).distinct().withColumn("o", F.explode(offsets))
    near = near.select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct()
    return views.points(spark, sf_dir).select("id", *px).join(near, ["cx", "cy"], "left_semi").select("id")


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 146195 WHEN 1 THEN 709 END AS number, CASE s_suppkey % 4 WHEN 0 THEN 'under_construction' WHEN 1 THEN 'operational' WHEN 2 THEN 'proposed' END AS status,
 CASE WHEN s_acctbal > 0 THEN s_acctbal END AS fee FROM supplier""")
def p6_p7_p12_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = F.when(k % 6 == 0, "1,46,195").when(k % 6 == 1, " 709 ").when(k % 6 == 2, "-").otherwise("1,2")
    said = F.when(k % 4 == 0, "FY 25-26").when(k % 4 == 1, "Completed in May").when(k % 4 == 2, "DPR under review").otherwise("soon")
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.whole_number(number).alias("number"), text.lifecycle(said).alias("status"), text.fee(F.col("s_acctbal").cast("string")).alias("fee"))


@query(f"""{with_("points")} SELECT id, (id % 10 <> 0 AND lon + 10 * (id % 3) BETWEEN 68 AND 98 AND lat BETWEEN 6 AND 37.5) AS good FROM points""")
def p19_valid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = F.when(F.col("id") % 10 == 0, "n/a").otherwise((F.col("lon") + 10 * (F.col("id") % 3)).cast("string"))
    return views.points(spark, sf_dir).select("id", geo.valid(lon, F.col("lat").cast("string"), (68.0, 6.0, 98.0, 37.5)).alias("good"))


@query("""SELECT c_custkey, CASE WHEN c_custkey * 3001 >= 2500000 THEN 'metro' WHEN c_custkey * 3001 >= 1000000 THEN 'large' ELSE 'emerging' END AS tier FROM customer""")
def p21_city_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", S.tier(F.col("c_custkey") * 3001).alias("tier"))


@query("""WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS i FROM s)
SELECT p_partkey, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM n""")
def p22_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-")
    own = read(spark, sf_dir, "part").select("p_partkey", base.alias("base"))
    i = F.row_number().over(W.partitionBy("base").orderBy("p_partkey"))
    return own.withColumn("i", i).select("p_partkey", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "i")).alias("slug"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN DATE '2024-03-05' END AS published, url LIKE 'http%' AS linked, split_part(split_part(url, '/', 3), ':', 1) AS host FROM pages""")
def p30_p31_item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://x.example/2024/03/05/"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, "http://x.example/2024/13/45/a").otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", text.url_date(url).alias("published"), F.col("url").rlike("^https?://").alias("linked"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'first' WHEN value > 50 THEN 'second' ELSE 'review' END AS rule,
 round_even(0.5 + CASE WHEN value > 10 THEN 0.2 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.15 ELSE 0 END, 3)::DOUBLE AS confidence FROM events""")
def p32_p33_rules_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("event_type").rlike("^(error|purchase)$"), "first").when(F.col("value") > 50, "second").otherwise("review")
    sure = F.lit(0.5) + F.when(F.col("value") > 10, 0.2).otherwise(0.0) + F.when(F.col("user_id") % 2 == 0, 0.15).otherwise(0.0)
    return read(spark, sf_dir, "events").select("event_id", rule.alias("rule"), F.bround(sure, 3).alias("confidence"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '\\d+')), lambda x: x NOT IN ('1', '2', '2024'))) = 0 AS grounded FROM documents""")
def p36_number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.array(F.lit("1"), F.lit("2"), F.lit("2024"))
    return read(spark, sf_dir, "documents").select("doc_id", text.grounded(F.col("text"), facts).alias("grounded"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(text, '\\P{L}', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '\\P{L}', '', 'g')) > 0.7 END AS latin FROM documents""")
def p38_latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.mostly_latin(F.col("text")).alias("latin"))


@query("""WITH g AS (SELECT c_nationkey AS k, arg_max(c_custkey, (c_custkey * 37 % 5000) * 1000000 - c_custkey) AS anchor, count(*) FILTER (c_custkey * 37 % 5000 >= 4990) AS big FROM customer GROUP BY 1) SELECT k, anchor, big >= 2 AS review FROM g""")
def w16_anchor_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", (F.col("c_custkey") * 37 % 5000).alias("people"))
    flagged = c.withColumn("big", F.sum((F.col("people") >= 4990).cast("int")).over(W.partitionBy("k")))
    return first_per(flagged, ["k"], F.desc("people"), "c_custkey").select("k", F.col("c_custkey").alias("anchor"), (F.col("big") >= 2).alias("review"))


@query("""SELECT l_orderkey AS trip_id FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS before FROM lineitem) WHERE l_linenumber <= before GROUP BY 1""")
def w17_sequence_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    steps = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("before"))
    return steps.where("l_linenumber <= before").select(F.col("l_orderkey").alias("trip_id")).distinct()


@query("""SELECT 'error' AS level, 'negative_balance' AS "check", count(*) AS count FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'warning', 'building', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def v5_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("error", "negative_balance", F.col("c_acctbal") < 0), ("warning", "building", F.col("c_mktsegment") == "BUILDING"), ("error", "no_name", F.col("c_name").isNull())]
    return quality.row_rules(read(spark, sf_dir, "customer"), rules)


@query("""SELECT p_type AS class, count(*) AS n, count(*) BETWEEN 30 AND 60 AS within FROM part GROUP BY 1""")
def v7_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("within", F.col("n").between(30, 60))


@query("""SELECT c_nationkey AS k, max(i) = count(*) AND count(*) = count(DISTINCT i) AS continuous FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + (c_nationkey % 4 = 0)::INT AS i FROM customer) GROUP BY 1""")
def v9_serial_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + (F.col("c_nationkey") % 4 == 0).cast("int")
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), i.alias("i"))
    return c.groupBy("k").agg(((F.max("i") == F.count("i")) & (F.count("i") == F.countDistinct("i"))).alias("continuous"))


@query("""SELECT l_suppkey AS key, round(sum(l_quantity), 2) AS km, count(*) AS pieces FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def c16_dissolve_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return own.groupBy(F.col("l_suppkey").alias("key")).agg(F.round(F.sum("l_quantity"), 2).alias("km"), F.count(F.lit(1)).alias("pieces"))


@query()
def s9_release_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.sources import readers

    return readers.releases(read(spark, sf_dir, "pages"))
