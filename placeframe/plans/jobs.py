"""Queries of whole jobs (areas, documents, feeds, releases), and of readers and writers on files made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.config import SCORING
from placeframe.functions import geo, text
from placeframe.functions import scoring as S
from placeframe.operators import areas, centres, events, feeds, graph, names, roads, spatial
from placeframe.plans import places, scores, views
from placeframe.plans.composite import _FILL
from placeframe.plans.roads import _E, _elements
from placeframe.plans.scores import _BANDS, _F, _case
from placeframe.plans.views import read, with_
from placeframe.sources import readers, writers
from placeframe.storage import shared_folder, table

QUERIES, SQL = {}, {}
_BOX = (68.0, 6.0, 98.0, 37.5)


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_DRAWS = areas.draws(SCORING, 200, 0.3, 20260929)
_W = ", ".join(f"('{p}', {d}, {', '.join(f'{v!r}::DOUBLE' for v in w)})" for p, d, w in _DRAWS)
_SUBS = ", ".join(_case(f, k) for f, k in _BANDS.items())


@query(f"""{with_("cells", "members")}, s AS (SELECT m.city, c.state, c.pop, {_SUBS} FROM members m JOIN cells c USING (cell)),
d(preset, draw, {", ".join(f"w_{f}" for f in _F)}) AS (VALUES {_W}),
r AS (SELECT preset, draw, state, city, sum(pop * ({" + ".join(f"coalesce(s_{f}, 0) * w_{f}" for f in _F)}) / ({" + ".join(f"CASE WHEN s_{f} IS NULL THEN 0 ELSE w_{f} END" for f in _F)})) / sum(pop) AS score
 FROM s, d WHERE ({" + ".join(f"CASE WHEN s_{f} IS NULL THEN 0 ELSE w_{f} END" for f in _F)}) > 0 GROUP BY ALL),
t AS (SELECT preset, draw, state, city FROM r QUALIFY row_number() OVER (PARTITION BY preset, draw, state ORDER BY score DESC, city) <= 3),
h AS (SELECT t.preset, t.draw, t.state, count(b.city) / count(*)::DOUBLE AS share FROM t LEFT JOIN t b ON b.draw = 0 AND b.preset = t.preset AND b.state = t.state AND b.city = t.city WHERE t.draw > 0 GROUP BY 1, 2, 3)
SELECT preset, round(avg(share), 6) AS retention FROM h GROUP BY 1""")
def c5_weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = views.members(spark, sf_dir).join(views.cells(spark, sf_dir).drop("city"), "cell")
    return areas.sensitivity(members, SCORING, _DRAWS, 3).select("preset", F.round("retention", 6).alias("retention"))


def _square(x: str, y: str) -> F.Column:
    return (F.floor(x) * 100 + F.floor(y)).cast("long")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, x, y, people: squares of a degree that hold places, with their people."""
    p = places._points(spark, sf_dir).withColumn("cell", _square("x", "y"))
    return p.groupBy("cell", (F.floor("x") + 0.5).alias("x"), (F.floor("y") + 0.5).alias("y")).agg(F.sum("w").alias("people"))


def _localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = places._targets(spark, sf_dir)
    return t.select("id", _square("x", "y").alias("cell"), "x", "y", F.when(F.col("id") % 8 > 0, F.col("id") % 8).alias("rank"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("name"))


_SQUARES = """sq AS (SELECT floor(lon)::BIGINT * 100 + floor(lat)::BIGINT AS cell, floor(lon) + 0.5 AS x, floor(lat) + 0.5 AS y, sum(w) AS people FROM points GROUP BY ALL),
loc AS (SELECT id, floor(lon)::BIGINT * 100 + floor(lat)::BIGINT AS cell, lon AS lx, lat AS ly, id % 8 AS rank, 'L' || id AS name FROM targets WHERE id % 8 > 0),
hit AS (SELECT sq.cell, name FROM sq JOIN loc USING (cell) QUALIFY row_number() OVER (PARTITION BY sq.cell ORDER BY rank, sqrt((lx - x) * (lx - x) + (ly - y) * (ly - y)), name) = 1),
near AS (SELECT sq.cell, name FROM sq, loc WHERE sq.cell NOT IN (SELECT cell FROM hit) AND sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) <= 1.5
 QUALIFY row_number() OVER (PARTITION BY sq.cell ORDER BY sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)), id) = 1),
named AS (SELECT cell, coalesce(hit.name, near.name) AS name FROM sq LEFT JOIN hit USING (cell) LEFT JOIN near USING (cell))"""


@query(f"{with_('points', 'targets')}, {_SQUARES} SELECT cell, name FROM named")
def j18_area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.named(_squares(spark, sf_dir), _localities(spark, sf_dir), 1.5, 1.0)


_KM = "(SELECT min(sqrt((x - lon) * (x - lon) + (y - lat) * (y - lat))) FROM targets WHERE kind = '{}')"


@query(f"{with_('points', 'targets')}, {_SQUARES} SELECT cell, people, name, round({_KM.format('rail')}, 6) AS rail_dist, round({_KM.format('metro')}, 6) AS metro_dist FROM sq JOIN named USING (cell) WHERE people >= 1000")
def c7_area_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.targets(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "kind")
    kinds = {k: t.where(F.col("kind") == k).drop("kind") for k in ("rail", "metro")}
    out = areas.facts(_squares(spark, sf_dir), kinds, _localities(spark, sf_dir), 1000, 1.5, 1.0)
    return out.select("cell", "people", "name", *[F.round(f"{k}_dist", 6).alias(f"{k}_dist") for k in kinds])


@query(f"""WITH s AS ({scores.SQL["c3_city_scores"]}), b AS ({scores.SQL["w8_best_area"].replace("4500", str(SCORING.best_area_people))}), f AS ({scores.SQL["c4_factor_summary"]}),
l AS (SELECT n_name AS city, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS licences FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT s.city, s.people, b.cell AS best, r.value AS rail, r.share AS rail_share, licences FROM s LEFT JOIN b USING (city) LEFT JOIN (SELECT * FROM f WHERE factor = 'rail_access') r USING (city) LEFT JOIN l USING (city)""")
def c8_city_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    sources = read(spark, sf_dir, "customer").join(n, "c_nationkey").select("city", F.col("c_mktsegment").alias("licence")).distinct()
    docs = areas.documents(scores._members(spark, sf_dir), SCORING, SCORING.default, sources)
    rail = F.try_element_at("doc.factors", F.lit("rail_access"))
    return docs.select("city", "doc.people", "doc.best", rail["value"].alias("rail"), rail["share"].alias("rail_share"), F.array_join("doc.licences", "; ").alias("licences"))


_EDGE = """CASE WHEN length2 > 0 THEN least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length2, 0), 1) ELSE 0 END"""


@query(f"""WITH a AS ({places.SQL["j7_point_in_polygon"]}), {with_("points")[5:]},
e AS (SELECT r_name AS edge, 68 + 6.0::DOUBLE * r_regionkey + c.x1 AS x1, c.y1, 68 + 6.0::DOUBLE * r_regionkey + c.x2 AS x2, c.y2 FROM region,
 (VALUES (0, 6, 6, 6), (6, 6, 6, 20), (6, 20, 3, 20), (3, 20, 3, 37.5), (3, 37.5, 0, 37.5), (0, 37.5, 0, 6)) AS c(x1, y1, x2, y2)),
o AS (SELECT id, lon AS x, lat AS y FROM points WHERE id IN (SELECT id FROM a WHERE name IS NULL)),
g AS (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS length2 FROM o, e), t AS (SELECT *, {_EDGE} AS t FROM g),
d AS (SELECT id, edge, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS dist FROM t),
n AS (SELECT id, edge FROM d WHERE dist <= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, edge) = 1)
SELECT id, coalesce(name, edge) AS name FROM a LEFT JOIN n USING (id)""")
def j8_nearest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_polygon(places._points(spark, sf_dir), places._polygons(spark, sf_dir), 1.0, 1.0)


@query()
def j11_fuzzy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts, in the order of their keys, take codes of odd parts of their brand with a like name."""
    part = read(spark, sf_dir, "part")
    keys = table(part.select("p_name").distinct().withColumn("key", text.name_key(F.col("p_name"))), "keys")  # a name's key is made once
    p = part.join(keys, "p_name").select("p_partkey", "key", F.col("p_brand").alias("state"))
    rows = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), "key", "state")
    return names.matched(rows, p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("code"), "key", "state"), 0.82)


@query()
def r7_circuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of large places over the network of all ways."""
    nodes = places._nodes(spark, sf_dir).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return graph.circuity(places._all_links(spark, sf_dir), nodes, places._points(spark, sf_dir).where("w >= 4900").drop("w"), 0.5, (0.5, 5.0), 1.0)


_FEEDS = """stops AS (SELECT s_nationkey AS feed, CASE WHEN s_suppkey % 61 = 5 THEN 'twice' ELSE s_suppkey::VARCHAR END AS stop_id, s_suppkey % 30 <> 3 AS good FROM supplier),
routes AS (SELECT c_nationkey AS feed, CASE WHEN c_custkey % 401 = 7 THEN '' ELSE c_custkey::VARCHAR END AS route_id FROM customer)"""


@query(f"""WITH {_FEEDS}, bad AS (SELECT feed FROM stops GROUP BY feed, stop_id HAVING count(*) > 1 UNION SELECT feed FROM routes GROUP BY feed, route_id HAVING count(*) > 1 OR route_id = ''),
c AS (SELECT feed, count(*) AS stops, count(*) FILTER (NOT good) AS bad FROM stops GROUP BY 1)
SELECT feed, coalesce(stops, 0) AS stops, coalesce(c.bad, 0) AS bad, round(c.bad / c.stops::DOUBLE, 6) AS share, coalesce(c.bad / c.stops::DOUBLE <= 0.05, false) AND feed NOT IN (SELECT feed FROM bad) AS accepted
FROM (SELECT feed FROM stops UNION SELECT feed FROM routes) LEFT JOIN c USING (feed)""")
def c15_feed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    stops = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feed"), F.when(k % 61 == 5, "twice").otherwise(k.cast("string")).alias("stop_id"), F.when(k % 30 == 3, "x").otherwise("77.5").alias("stop_lon"), F.lit("12.9").alias("stop_lat"))
    routes = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("feed"), F.when(c % 401 == 7, "").otherwise(c.cast("string")).alias("route_id"))
    return feeds.accepted({"stops": stops, "routes": routes}, _BOX)["summary"].withColumn("share", F.round("share", 6))


#: What the release query looks for in the pages.
RULES = [events.Rule(r"(?i)\b(?:the|a|of)\b", r"\w", "notice", "proposed"), events.Rule(r"\w", r"[0-9]", "figure", "under_construction")]


@query()
def c13_release_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a listed release whose listing gives its title; every ninth comes without a page."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    own = table(readers.releases(read(spark, sf_dir, "pages")).withColumn("posted", day), "releases")
    listed = own.select("page_id", "title", F.date_add("posted", (F.col("page_id") % 3).cast("int")).alias("published"))
    return events.classified(listed, own.where("page_id % 9 <> 0"), RULES)


@query("""SELECT o_orderkey AS id, 'NH' || (1 + o_orderkey % 998) || CASE WHEN o_orderkey % 998 = o_custkey % 98 THEN '' ELSE ' NH' || (1 + o_custkey % 98) END || ' NH7BB' AS refs,
 CASE o_orderkey % 3 WHEN 0 THEN 'Kerala Odisha' WHEN 1 THEN 'Jammu and Kashmir Goa' ELSE 'Bihar' END AS states, CASE WHEN o_orderkey % 2 = 0 THEN 'EPC' ELSE 'HAM' END AS modes FROM orders""")
def p28_fields_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, "Kerala & Odisha").when(k % 3 == 1, "Jammu and Kashmir, Goa").otherwise("the State of Bihar near Goa")
    kind = F.when(k % 2 == 0, "EPC mode").otherwise("Hybrid Annuity terms")
    said = F.concat(F.lit("Delhi link of NH-"), (1 + k % 998).cast("string"), F.lit(" to National Highway 0"), (1 + F.col("o_custkey") % 98).cast("string"), F.lit(" by NH 7 BB in "), place, F.lit(" on "), kind)
    found = [F.array_join(c, " ").alias(n) for n, c in (("refs", events.road_numbers(said)), ("states", events.states_named(F.replace(said, F.lit(" on "), F.lit(", on ")))), ("modes", events.modes_named(said)))]
    return read(spark, sf_dir, "orders").select(k.alias("id"), *found)


@query()
def p27_evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.evidence(F.split("text", "\n"), "[0-9]", 3, 200).alias("evidence"))


@query("""SELECT o_orderkey AS id, 'NH' || (1 + o_orderkey % 9999) || 'A NE2' AS refs, 'NH 12345' AS rejected FROM orders""")
def p3_road_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("nh-00"), (1 + F.col("o_orderkey") % 9999).cast("string"), F.lit("A; NE II / SH 17:NH 12345"))
    out = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.highway_refs(said).alias("r"))
    return out.select("id", F.array_join("r.refs", " ").alias("refs"), F.array_join("r.rejected", " ").alias("rejected"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS a, l_suppkey AS b, l_linenumber * 10 AS c, 1011 AS d, count(*) AS n FROM lineitem GROUP BY ALL""")
def p9_annexure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a scanned table, whose ones and noughts were read as letters."""
    li = read(spark, sf_dir, "lineitem")
    scan = lambda c: F.translate(c.cast("string"), "10", "lO")
    line = F.concat_ws(" ", F.lit("7."), F.lit("Area A & B"), scan(F.col("l_partkey")), scan(F.col("l_suppkey")), scan(F.col("l_linenumber") * 10), F.lit("1,]I|"), F.lit("3"))
    row = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), text.annexure_row(F.replace(line, F.lit("1,]I|"), F.lit("1,O]I"))).alias("r"))
    values = [F.get("r.values", i).alias(c) for i, c in enumerate("abcd")]
    return row.select("id", "line", *values).groupBy("id", "line", *"abcd").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'metro' ELSE 'rail' END
 WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'metro' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'rail' END AS mode,
 CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 END AS rank FROM orders""")
def p13_station_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    pairs = {"railway": F.when(s == "F", "halt"), "public_transport": F.when(s == "P", "station"), "station": F.when(k % 2 == 0, "subway"), "train": F.when(k % 3 == 0, "yes"), "was:railway": F.when(k % 7 == 0, "station")}
    tags = F.map_filter(F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    place = F.when(k % 3 == 0, "village").when(k % 3 == 1, "suburb").otherwise("farm")
    return read(spark, sf_dir, "orders").select(k.alias("id"), text.station_mode(tags).alias("mode"), text.place_rank(place).alias("rank"))


_LONG = "SELECT cell, f.factor, f.value, CASE WHEN cell % 3 = 0 THEN (cell * 31 % 101) / 100.0::DOUBLE END AS share FROM cells, LATERAL (VALUES {}) AS f(factor, value)".format(", ".join(f"('{f}', {f})" for f in _F))
_UP = "CASE factor WHEN 'nh_access' THEN {} WHEN 'rail_access' THEN {} WHEN 'metro_access' THEN {} END"


@query(f"""{with_("cells")}, l AS ({_LONG}), d AS (SELECT *, {_UP.format(10, 2, 2)} AS band, {_UP.format(25, 15, 10)} AS last FROM l)
SELECT cell, factor, 'why.' || factor || CASE WHEN band IS NOT NULL AND share IS NOT NULL THEN CASE WHEN floor(share * 100 + 0.5) = 0 THEN '.none' ELSE '.share' END WHEN value IS NULL THEN '.unknown'
 WHEN value > last THEN '.far' WHEN band IS NOT NULL THEN '.near' WHEN factor = 'built_up_growth' AND abs(floor(value + 0.5)) = 1 THEN '.one' ELSE '' END AS key,
 CASE WHEN band IS NOT NULL AND share IS NOT NULL THEN band WHEN value > last THEN last WHEN factor <> 'built_up_growth' THEN floor(value * 10 + 0.5) / 10 END::DOUBLE AS km,
 CASE WHEN band IS NOT NULL THEN nullif(floor(share * 100 + 0.5), 0) END::DOUBLE AS pct, CASE WHEN factor = 'built_up_growth' THEN floor(value + 0.5) END::DOUBLE AS pp FROM d""")
def p25_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.cells(spark, sf_dir)
    pairs = F.create_map(*[x for f in SCORING.names for x in (F.lit(f), F.col(f).cast("double"))])
    share = F.when(F.col("cell") % 3 == 0, F.col("cell") * 31 % 101 / F.lit(100.0))
    each = cells.select("cell", share.alias("share"), F.explode(pairs).alias("factor", "value"))
    return each.select("cell", "factor", S.explanation(SCORING, "why", F.col("factor"), F.col("value"), F.col("share")).alias("e")).select("cell", "factor", "e.*")


_N, _SCALE, _ORIGIN, _ECC = geo.conic_terms()


@query(f"""{with_("points")}, p AS (SELECT id, {_SCALE!r}::DOUBLE * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_ECC!r}::DOUBLE * sin(radians(lat))) / (1 + {_ECC!r}::DOUBLE * sin(radians(lat))), {_ECC / 2!r}::DOUBLE), {_N!r}::DOUBLE) AS r, {_N!r}::DOUBLE * radians(lon - 80) AS turn FROM points)
SELECT id, round(4000000 + r * sin(turn), 3) AS east, round(4000000 + {_ORIGIN!r}::DOUBLE - r * cos(turn), 3) AS north FROM p""")
def g4_conic_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.conic(F.col("lon"), F.col("lat"))
    return views.points(spark, sf_dir).select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(f"""{with_("way_nodes")}, s AS (SELECT way_id, lon AS a, lat AS b, lead(lon) OVER w AS c, lead(lat) OVER w AS d FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
h AS (SELECT way_id, radians(b + d) / 2 AS f, radians(b - d) / 2 AS g, radians(a - c) / 2 AS l FROM s WHERE c IS NOT NULL),
v AS (SELECT *, sin(g) ** 2 * cos(l) ** 2 + cos(f) ** 2 * sin(l) ** 2 AS s, cos(g) ** 2 * cos(l) ** 2 + sin(f) ** 2 * sin(l) ** 2 AS c FROM h),
u AS (SELECT *, atan2(sqrt(s), sqrt(c)) AS w FROM v WHERE s > 0), r AS (SELECT *, sqrt(s * c) / w AS r FROM u)
SELECT way_id, round(sum(2 * w * 6378.137 * (1 + 1 / 298.257223563::DOUBLE * ((3 * r - 1) / (2 * c) * sin(f) ** 2 * cos(g) ** 2 - (3 * r + 1) / (2 * s) * cos(f) ** 2 * sin(g) ** 2))), 4) AS km FROM r GROUP BY 1""")
def g2_ellipsoid_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.operators.roads import segments

    km = geo.ellipsoid_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    steps = segments(views.way_nodes(spark, sf_dir)).where("x1 <> x2 OR y1 <> y2")
    return steps.groupBy("way_id").agg(F.round(F.sum(km), 4).alias("km"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"{with_('points')} SELECT id, lon, lat, w FROM points")
def s5_s16_point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as features, a collection for each thousand, and read back."""
    own = views.points(spark, sf_dir).withColumn("at", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    path = _folder(spark, "features")
    writers.features(own, "Point", "at", "id", "w").write.text(path)
    schema = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<id:long,w:long>>"
    back = spark.read.schema("value string").text(path).select(F.from_json("value", schema).alias("f"))
    at = F.col("f.geometry.coordinates")
    return back.select("f.properties.id", F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"), "f.properties.w")


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 6 <> 0""")
def s3_tolerant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as comma-separated lines, every sixth of another width, read by the tolerant reader."""
    k = F.col("c_custkey")
    line = F.concat_ws(",", k.cast("string"), "c_name", "c_mktsegment", F.when(k % 6 == 0, "more"))
    path = _folder(spark, "lines")
    read(spark, sf_dir, "customer").select(line.alias("value")).write.option("header", False).text(path)
    return readers.tolerant_csv(spark, path, "id long, name string, segment string", header=False)


@query("""SELECT o_orderkey AS id, coalesce(nullif(trim(o_orderpriority), '2-HIGH'), o_orderstatus) AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderkey END AS code FROM orders""")
def p15_p18_names_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    english = F.when(F.col("o_orderpriority") == "2-HIGH", " ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    code = F.when(k % 3 == 0, F.concat(F.lit("0"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("A"))).otherwise(k.cast("string"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), text.preferred_name(english, F.col("o_orderstatus")).alias("name"), text.code_number(code).alias("code"))


@query("""WITH p AS (SELECT c_custkey AS row, c_custkey * 7 % 400 AS col, c_custkey % 5 AS value FROM customer) SELECT row, col, value, round(68 + (col + 0.5) * 0.05::DOUBLE, 6) AS lon, round(37 - (row + 0.5) * 0.05::DOUBLE, 6) AS lat FROM p
WHERE value > 0 AND col BETWEEN 80 AND 240 AND row BETWEEN 100 AND 300""")
def s13_s14_pixel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    grid = read(spark, sf_dir, "customer").select(k.alias("row"), (k * 7 % 400).alias("col"), (k % 5).alias("value"))
    half = 0.025  # the window's corners are centres of pixels
    own = readers.pixels(grid, (68.0, 37.0), (0.05, -0.05), (72 + half, 22 - half, 80 + half, 32 - half))
    return own.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query(f"""{_E}, k AS (SELECT way_id, CASE highway WHEN 'motorway' THEN 'expressway' WHEN 'trunk' THEN 'highway' WHEN 'construction' THEN 'building' END AS kind, CASE WHEN length(ref) <= 6 THEN ref END AS ref FROM e WHERE highway <> 'residential'),
f AS (SELECT l_orderkey AS way_id, 'NH' || min(l_suppkey) AS given FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS ({SQL["g2_ellipsoid_lengths"]})
SELECT way_id, kind, coalesce(ref, given) AS ref, km FROM k JOIN g USING (way_id) LEFT JOIN f USING (way_id)""")
def c11_road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _road_job(spark, sf_dir)["roads"].select("way_id", "kind", "ref", F.round("km", 4).alias("km"))


@query()
def c11_road_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ways have each fault."""
    return _road_job(spark, sf_dir)["errors"].groupBy("reason").agg(F.count(F.lit(1)).alias("ways"))


def _road_job(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    relations = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("relation_id"), F.concat(F.lit("NH"), F.col("l_suppkey").cast("string")).alias("ref"), F.col("l_orderkey").alias("way_id"))
    return roads.road_job(_elements(spark, sf_dir), relations, views.way_nodes(spark, sf_dir), places._polygons(spark, sf_dir), _BOX, 0.05, 0.5, 1.0)


@query()
def c10_station_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as mapped stations, customers of one market as listed ones."""
    t = views.targets(spark, sf_dir).select("id", F.col("kind").alias("mode"), (F.col("id") % 5).cast("string").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = places._points(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "rail").otherwise("metro").alias("mode"), (F.col("id") % 5).cast("string").alias("key"), "x", "y")
    return areas.stations(p, t, 1.2, 0.3)


@query("""SELECT c_custkey::VARCHAR AS customer_no, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey % 4 <> 0 THEN 'N' || c_nationkey END AS segment_2 FROM customer""")
def p16_standard_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", " N/A ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    nation = F.when(F.col("c_nationkey") % 4 == 0, "-").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return areas.standard_columns(c.select(F.col("c_custkey").alias("Customer (No.)"), segment.alias("Segment"), nation.alias("SEGMENT ")))


@query("""SELECT o_orderkey AS id, 'A' || o_orderkey AS name, o_custkey AS population FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 50""")
def s4_gazetteer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the lines of a tab-separated dump, read as places of one country."""
    given = {"country": F.when(F.col("o_orderstatus") == "F", "IN").otherwise("XX"), "population": F.col("o_custkey").cast("string")}
    columns = [c.strip().split()[0] for c in readers.GAZETTEER.split(",")]
    number, name = F.col("o_orderkey").cast("string"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))
    line = F.concat_ws("\t", *[given.get(c, number if i == 0 else name if i == 1 else F.lit("")) for i, c in enumerate(columns)])
    path = _folder(spark, "dump")
    read(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    out = readers.gazetteer(spark, path, "IN", 50)
    return out.select(F.col(columns[0]).cast("long").alias("id"), F.col(columns[1]).alias("name"), F.col("population").cast("long").alias("population"))


@query("""WITH l AS (SELECT c_nationkey AS file, c_custkey AS line, CASE WHEN c_custkey % 4 = 3 THEN c_name END AS a, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS b, 'x' || c_custkey AS c FROM customer),
h AS (SELECT file, coalesce(min(line) FILTER (a IS NOT NULL AND b IS NOT NULL), min(line)) AS top FROM l GROUP BY 1), n AS (SELECT file, top, a, b, c FROM l JOIN h USING (file) WHERE line = top)
SELECT file, l.line, n.c AS header, l.c AS value, CASE WHEN n.b IS NOT NULL THEN l.b END AS segment FROM l JOIN n USING (file) WHERE l.line > top""")
def p17_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the lines of a workbook's sheet for each nation, read below the first line that is full."""
    k = F.col("c_custkey")
    cells = F.array(F.when(k % 4 == 3, F.col("c_name")), F.when(k % 2 == 1, F.col("c_mktsegment")).otherwise(" "), F.concat(F.lit("x"), k.cast("string")))
    lines = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), k.alias("line"), cells.alias("cells"))
    names = F.map_keys("values")
    header, segment = F.element_at(names, -1), F.when(F.size(names) > 1, F.element_at(names, -2))
    return areas.below_header(lines).select("file", "line", header.alias("header"), F.try_element_at("values", header).alias("value"), F.try_element_at("values", segment).alias("segment"))


_ROW, _COL = "(c_custkey // 50)", "(c_custkey % 50)"
_IS_DENSE = f"({_ROW} // 6 + {_COL} // 9) % 3 = 0 AND ({_ROW} * 7 + {_COL} * 11) % 13 <> 0"


@query(f"""{_FILL.replace("WITH", "WITH RECURSIVE", 1).replace("FROM customer", f"FROM customer WHERE {_IS_DENSE}", 1)},
px AS (SELECT c_custkey // 50 AS row, c_custkey % 50 AS col, (c_custkey // 50) * 1000000 + c_custkey % 50 AS id, (c_custkey * 37 % 5000 + 1) * 100 AS people FROM customer WHERE {_IS_DENSE}),
r(id, o) AS (SELECT id, id FROM px UNION SELECT r.id, b.id FROM r JOIN px a ON a.id = r.o JOIN px b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
k AS (SELECT id, min(o) AS component FROM r GROUP BY 1), own AS (SELECT px.*, component, s3 AS state, coalesce(s3, '') AS of FROM px JOIN k USING (id) JOIN c3 ON c3.row = px.row AND c3.col = px.col),
pieces AS (SELECT component, of, min(id) AS label, min(state) AS state, sum(people)::BIGINT AS population, count(*) AS pixels FROM own GROUP BY 1, 2 HAVING sum(people) >= 500000),
p AS (SELECT s_suppkey AS id, (s_suppkey * 15 + s_suppkey % 15) // 50 AS row, (s_suppkey * 15 + s_suppkey % 15) % 50 AS col, s_suppkey * 37 % 5000 AS population, 'City ' || s_suppkey % 7 AS name FROM supplier),
i AS (SELECT p.*, component, of FROM p JOIN own USING (row, col) JOIN pieces USING (component, of)), a AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY component, of ORDER BY population DESC, id) = 1),
n AS (SELECT a.name, a.id AS anchor, pieces.*, replace(lower(a.name), ' ', '-') AS base FROM pieces JOIN a USING (component, of) WHERE state IS NOT NULL),
f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || lower(state) ELSE base END AS whole FROM n), g AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY population DESC, label) AS i FROM f)
SELECT whole || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS id, name, state, population, pixels, anchor, CASE WHEN population >= 2500000 THEN 'metro' WHEN population >= 1000000 THEN 'large' ELSE 'emerging' END AS tier FROM g""")
def c6_urban_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    row, col = F.floor(k / 50), k % 50
    dense = F.expr("(c_custkey div 50 div 6 + c_custkey % 50 div 9) % 3 = 0 AND (c_custkey div 50 * 7 + c_custkey % 50 * 11) % 13 <> 0")
    people = F.when(dense, (k * 37 % 5000 + 1) * 100).otherwise(0)
    px = read(spark, sf_dir, "customer").select(row.alias("row"), col.alias("col"), row.alias("y"), col.alias("x"), people.alias("people"), F.when(k % 5 != 0, F.concat(F.lit("S"), F.floor(k / 400))).alias("state"))
    at = s * 15 + s % 15
    there = read(spark, sf_dir, "supplier").select(s.alias("id"), F.floor(at / 50).alias("row"), (at % 50).alias("col"), F.concat(F.lit("City "), (s % 7).cast("string")).alias("name"), (s * 37 % 5000).alias("population"))
    made = centres.urban_centres(px, there, there.select("id", "name").limit(0), 1, 500_000, 4000)
    return made["centres"].select("id", "name", "state", "population", "pixels", "anchor", "tier")


def _city_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as cities of one square, and a box around it."""
    t = views.targets(spark, sf_dir).select(F.col("id").alias("city"), _square("lon", "lat").alias("cell"), F.floor("lon").alias("x0"), F.floor("lat").alias("y0"))
    return t, t.select("city", *[(F.col(c) - 0.125).alias(c) for c in ("x0", "y0")], *[(F.col(c) + 1.125).alias(c.replace("0", "1")) for c in ("x0", "y0")])


@query(f"""{with_("points", "targets")}, t AS (SELECT id AS city, floor(lon) AS x, floor(lat) AS y FROM targets), s AS (SELECT city, count(*) AS n FROM t JOIN points ON floor(points.lon) = x AND floor(points.lat) = y GROUP BY 1),
z AS (SELECT city, count(*) AS plazas FROM t JOIN points ON lon BETWEEN x - 0.125 AND x + 1.125 AND lat BETWEEN y - 0.125 AND y + 1.125 GROUP BY 1)
SELECT city, coalesce(n, 0) AS stations, coalesce(plazas, 0) AS plazas, coalesce(city % 10 = 0 AND n IS NOT NULL, false) AS mismatch FROM t LEFT JOIN s USING (city) LEFT JOIN z USING (city)""")
def c9_city_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stations and plazas; every tenth city's facts count one station too many."""
    t, boxes = _city_boxes(spark, sf_dir)
    p = places._points(spark, sf_dir)
    stations = p.select("id", "x", "y", _square("x", "y").alias("cell"))
    counted = t.join(stations.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").select("city", (F.col("n") + (F.col("city") % 10 == 0).cast("int")).alias("stations"))
    made = centres.layers(t, stations, counted, p.select("id", "x", "y"), boxes, 1.0)
    out = views.targets(spark, sf_dir).select(F.col("id").alias("city")).join(made["numbers"], "city", "left")
    wrong = made["mismatches"].select("city", F.lit(True).alias("mismatch"))
    return out.join(wrong, "city", "left").select("city", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stations", "plazas")], F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


@query()
def c9_city_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the merged and simplified road lines in each city's box."""
    ways = roads.classified(_elements(spark, sf_dir)).where("kind IN ('highway', 'expressway') AND status = 'operational'")
    steps = roads.segments(views.way_nodes(spark, sf_dir)).join(ways.select("way_id", F.get("refs", 0).alias("ref"), "status", "kind"), "way_id")
    return centres.city_roads(steps.drop("length", "start"), _city_boxes(spark, sf_dir)[1], 0.001, 1.0)


@query()
def g11_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the lines that all ways of one status make, from junction to junction."""
    own = roads.segments(views.way_nodes(spark, sf_dir)).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_orderstatus").alias("status")), "way_id")
    return roads.merged(own.withColumn("id", F.col("way_id") * 1_000_000 + F.col("pos")), ["status"], 0.01)
