"""Queries of roads, names, listings and checks on the given tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.functions import text
from placeframe.operators import quality, roads, spatial
from placeframe.operators.rank import first_per, numbered, quantiles
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


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, rel, tags: orders as elements with tags."""
    o = read(spark, sf_dir, "orders")
    highway = F.when(F.col("o_orderpriority") == "1-URGENT", "motorway").when(F.col("o_orderpriority") == "2-HIGH", "trunk").when(F.col("o_orderstatus") == "P", "construction").otherwise("residential")
    ref = F.when((F.col("o_totalprice") > 100000) & (F.col("o_custkey") > 0), F.concat(F.lit("NH "), F.col("o_custkey").cast("string")))
    oneway = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "-1")
    lanes = F.floor(F.col("o_totalprice") / 50000).cast("string")
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("ref"), ref, F.lit("oneway"), oneway, F.lit("lanes"), lanes), lambda k, v: v.isNotNull())
    return o.select(F.col("o_orderkey").alias("way_id"), F.col("o_custkey").alias("rel"), tags.alias("tags"))


_E = """WITH e AS (SELECT o_orderkey AS way_id, o_custkey AS rel,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'motorway' WHEN o_orderpriority = '2-HIGH' THEN 'trunk' WHEN o_orderstatus = 'P' THEN 'construction' ELSE 'residential' END AS highway,
  CASE WHEN o_totalprice > 100000 AND o_custkey > 0 THEN 'NH' || o_custkey END AS ref,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '-1' END AS oneway, floor(o_totalprice / 50000)::BIGINT AS lanes FROM orders)"""


@query(f"{_E} SELECT way_id, highway, ref FROM e WHERE highway IN ('motorway', 'trunk') AND ref LIKE 'NH%' AND lanes >= 2")
def s10_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    hit = tag("highway").isin("motorway", "trunk") & tag("ref").rlike("^NH") & (tag("lanes").cast("int") >= 2)
    return e.where(hit).select("way_id", tag("highway").alias("highway"), F.replace(tag("ref"), F.lit(" "), F.lit("")).alias("ref"))


@query(f"""{_E}, k AS (SELECT *, CASE highway WHEN 'motorway' THEN 'expressway' WHEN 'trunk' THEN 'highway' WHEN 'construction' THEN 'building' ELSE 'other' END AS kind FROM e)
SELECT way_id, kind, CASE kind WHEN 'building' THEN 'under_construction' ELSE 'operational' END AS status, CASE WHEN length(ref) <= 6 THEN ref END AS ref,
 CASE WHEN oneway = '-1' THEN -1 WHEN oneway = 'yes' OR (kind = 'expressway' AND oneway IS NULL) THEN 1 ELSE 0 END AS oneway,
 CASE WHEN lanes BETWEEN 1 AND 16 THEN lanes END::INT AS lanes, CASE WHEN lanes < 1 OR lanes > 16 THEN 'unknown' WHEN lanes < 2 THEN '<2' WHEN lanes <= 3 THEN '2' WHEN lanes <= 5 THEN '4' ELSE '6+' END AS band,
 ref IS NULL OR length(ref) > 6 AS ref_missing FROM k""")
def p5_way_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = roads.classified(_elements(spark, sf_dir))
    return c.select("way_id", "kind", "status", F.get("refs", 0).alias("ref"), "oneway", "lanes", "band", "ref_missing")


@query(f"""{_E}, r AS (SELECT l_suppkey AS relation_id, 'NH' || l_suppkey AS ref, l_orderkey AS way_id FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT way_id, arg_min(ref, relation_id) AS given FROM r GROUP BY 1)
SELECT way_id, coalesce(ref, given) AS ref, CASE WHEN ref IS NOT NULL THEN 'way' WHEN given IS NOT NULL THEN 'relation' END AS source FROM e LEFT JOIN f USING (way_id)""")
def j13_inherited_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.replace(F.try_element_at("tags", F.lit("ref")), F.lit(" "), F.lit(""))
    relations = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("relation_id"), F.concat(F.lit("NH"), F.col("l_suppkey").cast("string")).alias("ref"), F.col("l_orderkey").alias("way_id"))
    return roads.inherited_refs(_elements(spark, sf_dir).select("way_id", ref.alias("ref")), relations)


_SEG = f"""{with_("way_nodes")}, s AS (SELECT way_id, pos, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
seg AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM s WHERE x2 IS NOT NULL)"""


@query(f"""{_SEG}, l AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length) OVER (PARTITION BY way_id) AS total FROM seg),
p AS (SELECT *, total * (part + 0.5) / 4 AS mid FROM l, unnest([0, 1, 2, 3]) AS u(part) WHERE length > 0)
SELECT way_id, part, round(x1 + (mid - start) / length * (x2 - x1), 6) AS x, round(y1 + (mid - start) / length * (y2 - y1), 6) AS y, round(total / 4, 6) AS share FROM p WHERE start <= mid AND mid < start + length""")
def g7_line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roads.sampled(views.way_nodes(spark, sf_dir), 4)
    return out.select("way_id", "part", *[F.round(c, 6).alias(c) for c in ("x", "y", "share")])


@query(f"""{with_("way_nodes")}, b AS (SELECT way_id, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM way_nodes GROUP BY 1),
m AS (SELECT *, 12.0 / 111.2 AS up, 12.0 / 111.2 / cos(radians((b + d) / 2)) AS side FROM b)
SELECT way_id, round(a - side, 6) AS x0, round(b - up, 6) AS y0, round(c + side, 6) AS x1, round(d + up, 6) AS y1 FROM m""")
def g9_way_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roads.boxes(views.way_nodes(spark, sf_dir), 12.0)
    return out.select("way_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""{_SEG}, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM seg),
t AS (SELECT *, greatest(0, least((75 - x1) / nullif(dx, 0), (85 - x1) / nullif(dx, 0)), least((12 - y1) / nullif(dy, 0), (24 - y1) / nullif(dy, 0))) AS t0,
 least(1, greatest((75 - x1) / nullif(dx, 0), (85 - x1) / nullif(dx, 0)), greatest((12 - y1) / nullif(dy, 0), (24 - y1) / nullif(dy, 0))) AS t1 FROM d
 WHERE NOT (dx = 0 AND NOT x1 BETWEEN 75 AND 85) AND NOT (dy = 0 AND NOT y1 BETWEEN 12 AND 24))
SELECT way_id, pos, round(x1 + t0 * dx, 6) AS x1, round(y1 + t0 * dy, 6) AS y1, round(x1 + t1 * dx, 6) AS x2, round(y1 + t1 * dy, 6) AS y2 FROM t WHERE t0 <= t1""")
def g10_clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roads.clipped(roads.segments(views.way_nodes(spark, sf_dir)), (75.0, 12.0, 85.0, 24.0))
    return out.select("way_id", "pos", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_MID = f"""{with_("points", "targets")}, m AS (SELECT id AS way_id, CASE kind WHEN 'rail' THEN 1 ELSE 0 END AS oneway, lon AS x, lat AS y, cos(radians(id * 37 % 360)) AS dx, sin(radians(id * 37 % 360)) AS dy FROM targets)"""


@query(f"""{_MID} SELECT way_id, CASE WHEN oneway <> 0 AND EXISTS (SELECT 1 FROM m b WHERE b.way_id <> a.way_id AND b.oneway <> 0
 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2 AND a.dx * b.dx + a.dy * b.dy < -0.5) THEN 0.5 ELSE 1 END::DOUBLE AS weight FROM m a""")
def g12_carriageways(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.targets(spark, sf_dir)
    turn = F.radians(F.col("id") * 37 % 360)
    m = t.select(F.col("id").alias("way_id"), F.when(F.col("kind") == "rail", 1).otherwise(0).alias("oneway"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))
    return roads.carriageways(m, 2.0)


@query(f"""{with_("points", "targets")}, p AS (SELECT a.id AS pair, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM targets a JOIN targets b ON b.id = a.id + 1),
d AS (SELECT pair, x1, y1, x2, y2, q.lon AS x, q.lat AS y, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM p, points q),
t AS (SELECT *, CASE WHEN l2 > 0 THEN least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2, 0), 1) ELSE 0 END AS t FROM d)
SELECT pair, count(*) FILTER (sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) <= 0.25) AS n FROM t GROUP BY pair""")
def j15_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.targets(spark, sf_dir)
    other = t.select((F.col("id") - 1).alias("id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    pairs = t.join(other, "id").select(F.col("id").alias("pair"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    points = views.points(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return roads.corridors(pairs, points, 0.25, 0.5)


@query("""WITH d AS (SELECT l_orderkey AS id, l_linenumber AS line, l_shipdate::DATE AS listed, l_returnflag AS flag FROM lineitem)
SELECT id, line, listed, o_orderdate::DATE AS reported, abs(date_diff('day', o_orderdate::DATE, listed)) <= 30 AND starts_with(o_orderstatus, CASE flag WHEN 'N' THEN 'O' ELSE 'F' END) AS agrees FROM d JOIN orders ON o_orderkey = id""")
def j21_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed against reported records of one id: dates at most a month apart and the status as it begins."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("listed"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("begins"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("reported"), "o_orderstatus")
    agrees = (F.abs(F.datediff("listed", "reported")) <= 30) & F.startswith("o_orderstatus", F.col("begins"))
    return d.join(o, "id").select("id", "line", "listed", "reported", agrees.alias("agrees"))


@query("""SELECT o_orderstatus AS state, count(*) AS ways, round(count(*) FILTER (o_totalprice > 250000) / count(*), 6) AS tolled_share, median(CASE WHEN o_totalprice > 250000 THEN o_totalprice END) AS median_fee,
 round(count(DISTINCT o_custkey) * 100.0 / count(*), 6) AS points_per_100 FROM orders GROUP BY 1""")
def a17_toll_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    tolled = F.col("o_totalprice") > 250000
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(
        F.count(F.lit(1)).alias("ways"),
        F.round(F.count_if(tolled) / F.count(F.lit(1)), 6).alias("tolled_share"),
        F.median(F.when(tolled, F.col("o_totalprice"))).alias("median_fee"),
        F.round(F.countDistinct("o_custkey") * 100.0 / F.count(F.lit(1)), 6).alias("points_per_100"),
    )


@query("""WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), d AS (SELECT round(p_retailprice) AS r, count(*) AS n FROM part GROUP BY 1)
SELECT 'rows' AS measure, count(*)::DOUBLE AS value FROM part UNION ALL SELECT 'names', count(*) FROM n UNION ALL SELECT 'names_repeated', count(*) FROM n WHERE n > 1
UNION ALL SELECT 'rows_at_a_shared_place', coalesce(sum(n), 0) FROM d WHERE n > 1 UNION ALL SELECT 'least', min(p_retailprice) FROM part UNION ALL SELECT 'most', max(p_retailprice) FROM part""")
def a27_station_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, names, repeated names, rows that share a rounded place, and extents, as measure and value."""
    p = read(spark, sf_dir, "part")
    named = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > 1).alias("names_repeated"), F.sum("n").alias("rows"))
    placed = p.groupBy(F.round("p_retailprice").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    placed = placed.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_at_a_shared_place"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    one = named.crossJoin(placed)  # one row each
    names = ["rows", "names", "names_repeated", "rows_at_a_shared_place", "least", "most"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("m.*")


@query("""SELECT s_nationkey AS system, count(*) AS lines, CASE WHEN s_nationkey % 3 <> 0 THEN sum(n) END AS stations, sum(q)::DOUBLE AS riders
FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey GROUP BY 1""")
def a29_system_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, stations (null where a system's source has none) and riders of each system."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("n"), F.sum("l_quantity").alias("q"))
    own = read(spark, sf_dir, "supplier").join(li, "s_suppkey")
    return own.groupBy(F.col("s_nationkey").alias("system")).agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n"), F.sum("q").alias("riders")).select("system", "lines", F.when(F.col("system") % 3 != 0, F.col("n")).alias("stations"), "riders")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.9) AS p90, median(l_extendedprice) AS p50 FROM lineitem)
SELECT round(p90, 4) AS p90, round(p50, 4) AS median, count(*) AS segments, count(*) FILTER (l_extendedprice > p90) AS long_gaps, count(*) FILTER (l_extendedprice > 2 * p50) AS over_twice_median,
 count(*) FILTER (l_extendedprice > p90) * 20 > count(*) AS flagged FROM lineitem, q GROUP BY p90, p50""")
def a36_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, counts and a flag of the network's gaps, in one row."""
    li = read(spark, sf_dir, "lineitem")
    one = quantiles(li, "l_extendedprice", {"p90": 0.9, "p50": 0.5})
    far = F.col("l_extendedprice") > F.col("p90")
    out = li.crossJoin(F.broadcast(one)).groupBy("p90", "p50").agg(F.count(F.lit(1)).alias("segments"), F.count_if(far).alias("long_gaps"), F.count_if(F.col("l_extendedprice") > 2 * F.col("p50")).alias("over_twice_median"))
    return out.select(F.round("p90", 4).alias("p90"), F.round("p50", 4).alias("median"), "segments", "long_gaps", "over_twice_median", (F.col("long_gaps") * 20 > F.col("segments")).alias("flagged"))


@query("""WITH t AS (SELECT l_suppkey AS route, l_orderkey AS trip, count(*) AS stops FROM lineitem GROUP BY 1, 2),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY route ORDER BY stops DESC, trip) = 1)
SELECT route, trip, stops, string_agg(l_partkey::VARCHAR, '-' ORDER BY l_linenumber, l_partkey) AS line FROM b JOIN lineitem ON l_suppkey = route AND l_orderkey = trip GROUP BY 1, 2, 3""")
def w19_route_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trip with most stop rows of each route, as a line of its stops."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route"), F.col("l_orderkey").alias("trip"), "l_linenumber", "l_partkey")
    trips = li.groupBy("route", "trip").agg(F.count(F.lit(1)).alias("stops"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    best = first_per(trips, ["route"], F.desc("stops"), "trip")
    return best.select("route", "trip", "stops", F.array_join(F.transform("s", lambda x: x["l_partkey"].cast("string")), "-").alias("line"))


@query("""SELECT s_suppkey, v, row_number() OVER (ORDER BY coalesce(v, -1), s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier)""")
def w20_sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows in the order of a column, missing values as -1, with their place."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"))
    return numbered(rows.withColumn("o", F.coalesce("v", F.lit(-1.0))), "place", "o", "s_suppkey").drop("o")


# the longest block that both names have (of equal ones the first in the one, then in the other), and so on to its left and right
@query("""WITH RECURSIVE k AS (SELECT p_partkey AS p, lower(p_name) AS a, lower(p_type) || ' ' || string_split(lower(p_name), ' ')[1] AS b FROM part),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM k),
o AS (SELECT *, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS s, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS l FROM w),
c AS (SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS g FROM k, unnest(range(1, length(a) + 1)) AS u(i), unnest(range(1, length(b) + 1)) AS v(j) WHERE a[i] = b[j]),
runs AS (SELECT p, i, j, max(i) OVER (PARTITION BY p, i - j, g) - i + 1 AS run FROM c),
spans AS (SELECT p, 1::BIGINT AS alo, length(a) + 1 AS ahi, 1::BIGINT AS blo, length(b) + 1 AS bhi, 0::BIGINT AS m FROM k
 UNION ALL SELECT p, CASE WHEN side = 0 THEN alo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + n END, CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN n ELSE 0 END
 FROM (SELECT t.*, i, j, least(run, ahi - i, bhi - j) AS n FROM spans t JOIN runs r ON r.p = t.p AND i >= alo AND i < ahi AND j >= blo AND j < bhi
       QUALIFY row_number() OVER (PARTITION BY t.p, alo, ahi, blo, bhi ORDER BY least(run, ahi - i, bhi - j) DESC, i, j) = 1), (VALUES (0), (1)) AS e(side)),
total AS (SELECT p, sum(m) AS m FROM spans GROUP BY p)
SELECT p AS p_partkey, a AS name, CASE WHEN list_has_all(l, s) AND list_max(list_transform(s, lambda v: length(v))) >= 4 THEN 1.0 ELSE 2.0 * m / (length(a) + length(b)) END::DOUBLE AS similarity FROM o JOIN total USING (p)""")
def p10_p11_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    own = text.name_key(F.col("p_name"))
    other = text.name_key(F.concat_ws(" ", "p_type", F.get(F.split("p_name", " "), 0)))
    return p.select("p_partkey", own.alias("name"), other.alias("b")).select("p_partkey", "name", text.name_similarity(F.col("name"), F.col("b")).alias("similarity"))


@query("""SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '^ | $', '', 'g') <> '' AS has_text,
 contains(coalesce(text, ''), string_split(coalesce(text, ''), chr(10))[1]) AND trim(string_split(coalesce(text, ''), chr(10))[1], ' ') <> '' AS quoted FROM documents""")
def p26_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's first line, as a quote, stands in it word for word."""
    own = F.coalesce("text", F.lit(""))
    line = F.get(F.split(own, "\n"), 0)
    return read(spark, sf_dir, "documents").select("doc_id", (text.normal_form(own) != "").alias("has_text"), text.quoted_in(line, own).alias("quoted"))


@query("""SELECT event_id, CASE WHEN lon IS NULL OR lat IS NULL THEN 'MISSING' WHEN lon BETWEEN 10 AND 60 AND lat BETWEEN 0 AND 20 THEN 'VALID' WHEN lat BETWEEN 10 AND 60 AND lon BETWEEN 0 AND 20 THEN 'SWAP?' ELSE 'OUT_OF_RANGE' END AS class
FROM (SELECT event_id, value AS lon, CASE WHEN event_type = 'view' THEN NULL ELSE (json_extract_string(props, '$.k'))::DOUBLE END AS lat FROM events)""")
def p20_coordinate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k"))
    return read(spark, sf_dir, "events").select("event_id", text.coordinate_class(F.col("value").cast("string"), lat, (10.0, 0.0, 60.0, 20.0)).alias("class"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def s6_listing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of nested JSON listings (a document for each user: days, each with a list), once each: the first one."""
    day = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("items"))
    documents = day.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("day", "items"))).alias("json"))
    parsed = documents.withColumn("d", F.from_json("json", "array<struct<day:string,items:array<struct<event_id:long,event_type:string>>>>"))
    entries = parsed.select("user_id", F.explode("d").alias("d")).select("user_id", F.explode("d.items").alias("i")).select("user_id", "i.event_type", "i.event_id")
    return first_per(entries, ["user_id", "event_type"], "event_id")


@query("""SELECT o_orderkey, o_orderpriority AS priority, count(*) OVER () = (SELECT count(*) FROM orders) AS complete FROM orders""")
def s21_kept_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only listed properties of each feature, and whether as many rows came as are reported."""
    o = read(spark, sf_dir, "orders")
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    kept = o.select("o_orderkey", F.map_filter(props, lambda k, v: k.isin("priority")).alias("props"))
    reported = o.agg(F.count(F.lit(1)).alias("reported")).crossJoin(kept.agg(F.count(F.lit(1)).alias("got")))
    return kept.crossJoin(F.broadcast(reported)).select("o_orderkey", F.try_element_at("props", F.lit("priority")).alias("priority"), (F.col("got") == F.col("reported")).alias("complete"))


def _links(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, DataFrame, str]]:
    t = lambda n: read(spark, sf_dir, n)
    return [
        ("stop_time_trip", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("stop_time_stop", t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        ("stop_time_agency", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        ("trip_route", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("route_region", t("customer"), "c_nationkey", t("nation"), "n_nationkey"),
        ("region_country", t("nation"), "n_regionkey", t("region"), "r_regionkey"),
    ]


_FK = " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(DISTINCT a.k) AS keys, count(DISTINCT CASE WHEN b.k IS NULL THEN a.k END) AS missing FROM (SELECT {c} AS k FROM {l}) a LEFT JOIN (SELECT DISTINCT {d} AS k FROM {r}) b ON a.k = b.k"
    for n, l, c, r, d in (("stop_time_trip", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("stop_time_stop", "lineitem", "l_partkey", "part", "p_partkey"), ("stop_time_agency", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("trip_route", "orders", "o_custkey", "customer", "c_custkey"), ("route_region", "customer", "c_nationkey", "nation", "n_nationkey"), ("region_country", "nation", "n_regionkey", "region", "r_regionkey"))
)


@query(f"SELECT relation, keys, missing, round(100.0 * missing / keys, 4) AS missing_pct FROM ({_FK})")
def v2_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six foreign keys: their different keys, and how many of these, in number and per cent, are missing."""
    out = []
    for name, left, c, right, d in _links(spark, sf_dir):
        keys = left.select(F.col(c).alias("k")).distinct().join(right.select(F.col(d).alias("k")).distinct().withColumn("there", F.lit(True)), "k", "left")
        out.append(keys.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("there").isNull()).alias("missing")).select(F.lit(name).alias("relation"), "keys", "missing"))
    return quality.all_of(*out).withColumn("missing_pct", F.round(F.lit(100.0) * F.col("missing") / F.col("keys"), 4))


@query("""SELECT 'error' AS level, 'null_code' AS "check", count(*) AS count FROM customer WHERE c_nationkey IS NULL OR c_custkey IS NULL HAVING count(*) > 0
UNION ALL SELECT 'error', 'unknown_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) HAVING count(*) > 0
UNION ALL SELECT 'warning', 'nation_without_suppliers', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) HAVING count(*) > 0
UNION ALL SELECT 'warning', 'customer_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0
UNION ALL SELECT 'warning', 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0""")
def v4_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null codes and unknown references are errors; places that nothing refers to only warn."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    bad = quality.row_rules(c, [("error", "null_code", F.col("c_nationkey").isNull() | F.col("c_custkey").isNull()), ("warning", "negative_balance", F.col("c_acctbal") < 0)])
    return quality.all_of(
        bad,
        quality.orphans(c.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", n, "unknown_nation", "error"),
        quality.orphans(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", read(spark, sf_dir, "supplier"), "nation_without_suppliers"),
        quality.orphans(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", read(spark, sf_dir, "orders"), "customer_without_orders"),
    )


@query(f"""{with_("cells")}, m AS (SELECT n_name AS city, c_custkey AS cell FROM customer JOIN nation ON n_nationkey = c_nationkey OR (c_custkey % 7 = 0 AND n_nationkey = (c_nationkey + 1) % 25)),
p AS (SELECT m.city, sum(cells.pop) AS pop, count(*) AS n FROM m JOIN cells ON m.cell = cells.cell GROUP BY 1)
SELECT 'warning' AS level, 'low_population' AS "check", count(*) AS count FROM p WHERE pop < 150000 HAVING count(*) > 0
UNION ALL SELECT 'error', 'member_in_several_cities', count(*) FROM (SELECT cell FROM m GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'error', 'city_without_cells', count(*) FROM nation WHERE n_name NOT IN (SELECT city FROM m) HAVING count(*) > 0
UNION ALL SELECT 'error', 'member_without_facts', count(*) FROM m LEFT JOIN cells ON m.cell = cells.cell WHERE cells.cell IS NULL OR cells.nh_access IS NULL HAVING count(*) > 0""")
def v6_export_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks ahead of an export: members of several cities or without facts, cities without cells or with few people."""
    m, cells = views.members(spark, sf_dir), views.cells(spark, sf_dir).select("cell", "pop", "nh_access")
    people = m.join(cells, "cell").groupBy("city").agg(F.sum("pop").alias("pop"))
    several = m.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cities = read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"))
    return quality.all_of(
        quality.issue("warning", "low_population", people.where("pop < 150000")),
        quality.issue("error", "member_in_several_cities", several),
        quality.orphans(cities, "city", m, "city_without_cells", "error"),
        quality.issue("error", "member_without_facts", m.join(cells, "cell", "left").where("nh_access IS NULL")),
    )


@query("""SELECT o_orderkey AS id, concat_ws(';', CASE WHEN o_totalprice < 50000 THEN 'low_confidence' END, CASE WHEN o_orderstatus = 'P' THEN 'no_lifecycle' END,
 CASE WHEN year(o_orderdate) > 2000 THEN 'date_out_of_range' END, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'no_anchor' END) AS reasons FROM orders""")
def v8_event_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an event is not verified, all reasons in one text."""
    rules = [
        ("low_confidence", F.col("o_totalprice") < 50000),
        ("no_lifecycle", F.col("o_orderstatus") == "P"),
        ("date_out_of_range", F.year("o_orderdate") > 2000),
        ("no_anchor", F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")),
    ]
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(";", *[F.when(hit, name) for name, hit in rules]).alias("reasons"))


@query(f"""{with_("points", "targets")}, d AS (SELECT t.id, min(sqrt((t.lon - o.lon) * (t.lon - o.lon) + (t.lat - o.lat) * (t.lat - o.lat))) AS spacing FROM targets t JOIN targets o ON t.id <> o.id GROUP BY 1),
q AS (SELECT quantile_cont(spacing, 0.9) AS p90 FROM d), b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM targets)
SELECT t.id, round(spacing, 6) AS spacing, spacing > p90 AS gap, lon < x0 + (x1 - x0) / 10 OR lon > x1 - (x1 - x0) / 10 OR lat < y0 + (y1 - y0) / 10 OR lat > y1 - (y1 - y0) / 10 AS edge FROM targets t JOIN d USING (id), q, b""")
def c18_station_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing to the nearest other station, whether it is a gap (above the 90th percentile), and whether the station is at the edge."""
    t = views.targets(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = spatial.nearest(t, t, 0.5, itself=False).select("id", F.col("dist").alias("spacing"))
    one = near.agg(F.percentile("spacing", 0.9).alias("p90")).crossJoin(t.agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]))  # one row
    tenth = lambda c: (F.col(f"{c}1") - F.col(f"{c}0")) / 10
    edge = F.lit(False)
    for c in "xy":
        edge |= (F.col(c) < F.col(f"{c}0") + tenth(c)) | (F.col(c) > F.col(f"{c}1") - tenth(c))
    return t.join(near, "id").crossJoin(F.broadcast(one)).select("id", F.round("spacing", 6).alias("spacing"), (F.col("spacing") > F.col("p90")).alias("gap"), edge.alias("edge"))
