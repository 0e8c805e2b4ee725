"""Queries that join by place, and graph queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.functions import geo, grid
from placeframe.operators import graph, spatial
from placeframe.plans import views
from placeframe.plans.views import with_
from placeframe.storage import table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.points(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "w")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.targets(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "kind")


_PT = with_("points", "targets")
_D = "sqrt((p.lon - t.lon) * (p.lon - t.lon) + (p.lat - t.lat) * (p.lat - t.lat))"


@query(f"""{_PT} SELECT id, target, round(dist, 6) AS dist FROM (SELECT p.id, t.id AS target, {_D} AS dist,
 row_number() OVER (PARTITION BY p.id ORDER BY {_D}, t.id) AS r FROM points p, targets t) WHERE r = 1""")
def j4_nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_points(spark, sf_dir), _targets(spark, sf_dir), 0.5).withColumn("dist", F.round("dist", 6))


@query(f"""{_PT}, n AS (SELECT p.id, t.id AS target, {_D} AS dist FROM points p, targets t WHERE {_D} <= 0.6)
SELECT points.id, target, round(dist, 6) AS dist FROM points LEFT JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, target) = 1) n USING (id)""")
def j4_nearest_target_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_points(spark, sf_dir), _targets(spark, sf_dir), 0.3, most=0.6).withColumn("dist", F.round("dist", 6))


@query(f"""{with_("points")} SELECT id, target, round(dist, 6) AS dist FROM (SELECT p.id, t.id AS target, {_D} AS dist,
 row_number() OVER (PARTITION BY p.id ORDER BY {_D}, t.id) AS r FROM points p JOIN points t ON p.id <> t.id) WHERE r = 1""")
def j5_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return spatial.nearest(p, p, 0.5, itself=False).withColumn("dist", F.round("dist", 6))


@query(f"""{_PT} SELECT p.id, t.id AS other, round({_D}, 6) AS dist FROM points p, targets t WHERE {_D} <= 1.5""")
def j6_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within(_points(spark, sf_dir), _targets(spark, sf_dir), 1.5, digits=6)


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of the map for each region, with a bite out of its right half."""
    k = F.col("r_regionkey") * 6.0 + 68.0
    corners = [(0.0, 6.0), (6.0, 6.0), (6.0, 20.0), (3.0, 20.0), (3.0, 37.5), (0.0, 37.5), (0.0, 6.0)]
    ring = F.array(*[F.struct((k + x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return views.read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), ring.alias("ring"))


@query(f"""{with_("points")}, s AS (SELECT r_name AS name, 68 + 6 * r_regionkey AS k FROM region)
SELECT id, min(name) AS name FROM points LEFT JOIN s ON lon >= k AND lon < k + 6 AND (lat < 20 OR lon < k + 3) GROUP BY id""")
def j7_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_polygon(_points(spark, sf_dir), _polygons(spark, sf_dir), 1.0)


@query("""SELECT r_name AS name, 6 * 14.0::DOUBLE + 3 * 17.5::DOUBLE AS area FROM region""")
def g5_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("name", geo.shoelace(F.col("ring")).alias("area"))


@query(f"""{_PT} SELECT t.id AS box, p.id FROM targets t JOIN points p ON p.lon BETWEEN t.lon - 0.8 AND t.lon + 0.8 AND p.lat BETWEEN t.lat - 0.4 AND t.lat + 0.4""")
def j9_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir)
    boxes = t.select(F.col("id").alias("box"), (F.col("x") - 0.8).alias("x0"), (F.col("y") - 0.4).alias("y0"), (F.col("x") + 0.8).alias("x1"), (F.col("y") + 0.4).alias("y1"))
    return spatial.in_box(_points(spark, sf_dir), boxes, 1.0)


_HAV = "2 * 6371.0088 * asin(sqrt(power(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * power(sin(radians(t.lon - p.lon) / 2), 2)))"


@query(f"""{_PT}, near AS (SELECT p.id, t.id AS target, row_number() OVER (PARTITION BY p.id ORDER BY {_D}, t.id) AS r FROM points p, targets t)
SELECT p.id, near.target, round({_HAV}, 4) AS haversine, round(111.2 * sqrt(power((t.lon - p.lon) * cos(radians((p.lat + t.lat) / 2)), 2) + power(t.lat - p.lat, 2)), 4) AS flat
FROM points p JOIN near ON near.id = p.id AND r = 1 JOIN targets t ON t.id = near.target""")
def g1_g3_nearest_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point and its nearest of all targets."""
    near = spatial.nearest(_points(spark, sf_dir), _targets(spark, sf_dir), 0.5).select("id", "target")
    t = views.targets(spark, sf_dir).select(F.col("id").alias("target"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    both = views.points(spark, sf_dir).join(near, "id").join(t, "target")
    ends = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return both.select("id", "target", F.round(geo.haversine_km(*ends), 4).alias("haversine"), F.round(geo.flat_km(*ends), 4).alias("flat"))


@query(f"SELECT id, haversine, flat FROM ({SQL['g1_g3_nearest_distances']})")
def g1_g3_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g1_g3_nearest_distances(spark, sf_dir).drop("target")


@query(f"""{with_("points")} SELECT id, CASE WHEN floor((lon - 70) / 0.25) BETWEEN 0 AND 79 THEN floor((lon - 70) / 0.25)::BIGINT END AS col,
 CASE WHEN floor((lat - 8) / 0.5) BETWEEN 0 AND 39 THEN floor((lat - 8) / 0.5)::BIGINT END AS "row" FROM points""")
def g6_pixel_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    return p.select("id", geo.pixel(F.col("lon"), 70, 0.25, 80).alias("col"), geo.pixel(F.col("lat"), 8, 0.5, 40).alias("row"))


@query(f"""{_PT} SELECT p.id, round(CASE WHEN k <= 0 THEN sqrt(power(p.lon - 75, 2) + power(p.lat - 10, 2)) WHEN k >= 1 THEN sqrt(power(p.lon - 90, 2) + power(p.lat - 30, 2))
 ELSE abs((p.lon - 75) * 20 - (p.lat - 10) * 15) / 25 END, 6) AS dist
FROM (SELECT *, ((lon - 75) * 15 + (lat - 10) * 20) / 625 AS k FROM points) p""")
def g8_point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.lit(float(v)) for v in (75, 10, 90, 30)]
    return views.points(spark, sf_dir).select("id", F.round(geo.to_segment(F.col("lon"), F.col("lat"), *ends), 6).alias("dist"))


_SQ3 = math.sqrt(3)


@query(f"""{with_("points")}, a AS (SELECT *, (lon * {_SQ3 / 3!r}::DOUBLE - lat / 3) / 0.7::DOUBLE AS q, lat * {2 / 3!r}::DOUBLE / 0.7::DOUBLE AS r FROM points),
b AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b)
SELECT ((CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END) * 4294967296 + CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END + 2147483648)::BIGINT AS cell,
 count(*) AS n, sum(w)::BIGINT AS people FROM c GROUP BY 1""")
def g14_hexagon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir).withColumn("cell", grid.cell(F.col("lon"), F.col("lat"), 0.7))
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("people"))


@query(f"""{_PT}, near AS (SELECT a.id AS a, b.id AS b FROM targets a JOIN targets b ON a.id < b.id AND sqrt(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2)) <= 1.2),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT id, id AS r FROM targets) SELECT * FROM (WITH RECURSIVE c(id, r) AS (SELECT id, id FROM targets UNION SELECT c.id, b FROM c JOIN both_ways ON a = r)
SELECT place, count(*) AS n, round(avg(lon), 6) AS lon FROM (SELECT id, min(r) AS place FROM c GROUP BY id) JOIN targets USING (id) GROUP BY place)""")
def r4_cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir)
    labels = graph.components(spatial.pairs(t, 1.2))
    named = t.join(labels, F.col("id") == F.col("v"), "left").withColumn("place", F.coalesce("c", "id"))
    return named.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("lon"))


_DENSE = "(row // 6 + col // 9) % 3 = 0 AND (row * 7 + col * 11) % 13 <> 0"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, value: one pixel for each customer, dense in blobs."""
    key = F.col("c_custkey")
    return views.read(spark, sf_dir, "customer").select(F.floor(key / 50).alias("row"), (key % 50).alias("col"), (key * 37 % 5000 + 1).alias("value"))


@query(f"""WITH RECURSIVE px AS (SELECT c_custkey // 50 AS row, c_custkey % 50 AS col, c_custkey * 37 % 5000 + 1 AS value FROM customer),
dense AS (SELECT *, row * 1000000 + col AS id FROM px WHERE {_DENSE}),
c(id, r) AS (SELECT id, id FROM dense UNION SELECT c.id, b.id FROM c JOIN dense a ON a.id = c.r JOIN dense b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1)
SELECT component, count(*) AS pixels, sum(value)::BIGINT AS people, round(sum(value * row) / sum(value)::DOUBLE, 6) AS row_centre FROM (SELECT id, min(r) AS component FROM c GROUP BY id) JOIN dense USING (id) GROUP BY component""")
def r1_a4_contiguous_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).where("(row div 6 + col div 9) % 3 = 0 AND (row * 7 + col * 11) % 13 <> 0")
    px = px.join(graph.contiguous(px), ["row", "col"])
    row, col = graph.cell_of(F.col("component"))
    px = px.withColumn("component", row * 1_000_000 + col)
    centre = F.sum(F.col("value") * F.col("row")) / F.sum("value")
    return px.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("people"), F.round(centre, 6).alias("row_centre"))


_EDGES = f"""{with_("way_nodes")}, e AS (SELECT way_id, node_id AS a, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM way_nodes),
link AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(1 + (a + b) % 7)::DOUBLE AS length FROM e WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2),
both_ways AS (SELECT a, b, length FROM link UNION ALL SELECT b, a, length FROM link)"""


def _links(e: DataFrame) -> DataFrame:
    length = 1.0 + (F.col("a") + F.col("b")) % 7
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), length.alias("length")).groupBy("a", "b").agg(F.min("length").alias("length"))


def _all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(_links(views.way_links(spark, sf_dir)), "links")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.way_nodes(spark, sf_dir).select("node_id", "lon", "lat").distinct()


@query(f"""{with_("way_nodes")}, e AS (SELECT way_id, pos, node_id, lead(node_id) OVER w AS nxt, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, count(*) AS nodes, round(sum(coalesce(sqrt(power(lon - lon0, 2) + power(lat - lat0, 2)), 0)), 6) AS length FROM e GROUP BY way_id""")
def w5_s12_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("way_id").orderBy("pos")
    dx, dy = F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w)
    steps = views.way_nodes(spark, sf_dir).withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return steps.groupBy("way_id").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("step"), 6).alias("length"))


@query()
def r3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ways by their nodes. No SQL: recursion doesn't get through this network."""
    return graph.components(_all_links(spark, sf_dir)).groupBy(F.col("c").alias("component")).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""{_EDGES} SELECT a AS node_id FROM both_ways GROUP BY a HAVING count(DISTINCT b) = 1""")
def r5_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dead_ends(_all_links(spark, sf_dir))


@query()
def r6_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths over all ways from every twentieth node. No SQL, as for r3_components."""
    return r6_network_paths(spark, sf_dir)


@query()
def r3_network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ways with size, length and centre."""
    made = graph.component_summary(_all_links(spark, sf_dir), _nodes(spark, sf_dir))
    return made.select("component", "nodes", F.round("length", 6).alias("length"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query()
def r5_network_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead ends of all ways."""
    return graph.dead_ends(_all_links(spark, sf_dir))


@query()
def r5_gap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dead end of all ways to its nearest node that it has no link to."""
    made = graph.gaps(_all_links(spark, sf_dir), _nodes(spark, sf_dir), 0.5)
    return made.withColumn("dist", F.round("dist", 6))


@query()
def r6_network_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths over all ways from every twentieth node."""
    links = _all_links(spark, sf_dir)
    nodes = links.select(F.col("a").alias("node_id")).union(links.select("b")).distinct().where("node_id % 20 = 0")
    return graph.shortest_paths(links, nodes, 14.0)


@query()
def r8_thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return graph.thinned_points(p.withColumnRenamed("w", "priority"), 0.5).select("id", "priority")
