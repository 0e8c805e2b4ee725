"""Graph queries on a network of many parts with dead ends: small enough in each part for recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.operators import graph
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


_EDGES = f"""{with_("street_nodes")}, e AS (SELECT way_id, node_id AS a, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM street_nodes),
link AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(1 + (a + b) % 7)::DOUBLE AS length FROM e WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2),
both_ways AS (SELECT a, b, length FROM link UNION ALL SELECT b, a, length FROM link), n AS (SELECT DISTINCT node_id, lon, lat FROM street_nodes)"""
_RECURSIVE = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.edges_of(views.street_nodes(spark, sf_dir))
    length = 1.0 + (F.col("a") + F.col("b")) % 7
    return table(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), length.alias("length")).groupBy("a", "b").agg(F.min("length").alias("length")), "links")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.street_nodes(spark, sf_dir).select("node_id", "lon", "lat").distinct()


@query(f"""{_RECURSIVE}, c(id, r) AS (SELECT a, a FROM both_ways UNION SELECT c.id, b FROM c JOIN both_ways ON a = r), m AS (SELECT id, min(r) AS component FROM c GROUP BY 1),
s AS (SELECT component, count(*) AS nodes, avg(lon) AS lon, avg(lat) AS lat FROM m JOIN n ON node_id = id GROUP BY 1), k AS (SELECT component, sum(length) AS length FROM link JOIN m ON id = a GROUP BY 1)
SELECT component, nodes, round(length, 6) AS length, round(lon, 9) AS lon, round(lat, 9) AS lat FROM s JOIN k USING (component)""")
def r3_street_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the streets with its nodes, length and centre."""
    made = graph.component_summary(_links(spark, sf_dir), _nodes(spark, sf_dir))
    return made.select("component", "nodes", F.round("length", 6).alias("length"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(f"{_EDGES} SELECT a AS node_id FROM both_ways GROUP BY a HAVING count(DISTINCT b) = 1")
def r5_street_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dead_ends(_links(spark, sf_dir))


@query(f"""{_EDGES}, d AS (SELECT a AS node_id FROM both_ways GROUP BY a HAVING count(DISTINCT b) = 1),
p AS (SELECT n.node_id, o.node_id AS other, sqrt((n.lon - o.lon) * (n.lon - o.lon) + (n.lat - o.lat) * (n.lat - o.lat)) AS dist FROM d JOIN n USING (node_id) JOIN n o ON o.node_id <> n.node_id AND o.lon BETWEEN n.lon - 0.1 AND n.lon + 0.1 AND o.lat BETWEEN n.lat - 0.1 AND n.lat + 0.1)
SELECT node_id, other, round(dist, 6) AS dist FROM p WHERE dist <= 0.05 AND NOT EXISTS (SELECT 1 FROM both_ways WHERE a = node_id AND b = other) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY dist, other) = 1""")
def r5_street_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dead end to the nearest node that it has no link to."""
    return graph.gaps(_links(spark, sf_dir), _nodes(spark, sf_dir), 0.05).withColumn("dist", F.round("dist", 6))


@query(f"""{_RECURSIVE}, w(source, node, dist) AS (SELECT DISTINCT a, a, 0::DOUBLE FROM both_ways WHERE a % 5 = 0 UNION SELECT source, b, dist + length FROM w JOIN both_ways ON a = node WHERE dist + length <= 9)
SELECT source, node, min(dist) AS dist FROM w GROUP BY 1, 2""")
def r6_street_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest ways along streets, up to a length of 9, from the nodes with public stops (every fifth number)."""
    links = _links(spark, sf_dir)
    stops = links.select(F.col("a").alias("node_id")).union(links.select("b")).distinct().where("node_id % 5 = 0")
    return graph.shortest_paths(links, stops, 9.0)
