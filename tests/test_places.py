from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from placeframe.functions import geo, grid
from placeframe.operators import graph, spatial

POINT = "id long, x double, y double"


def scattered(n, seed):
    r = random.Random(seed)
    return [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(n)]


def test_nearest_meets_brute_force(spark):
    p, t = scattered(60, 1), [*scattered(9, 2), (50, 40.0, 40.0)]
    made = {r.id: (r.target, r.dist) for r in spatial.nearest(spark.createDataFrame(p, POINT), spark.createDataFrame(t, POINT), 0.2).collect()}
    for i, x, y in p:
        d, k = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in t)
        assert made[i] == (k, pytest.approx(d))


def test_nearest_without_targets_or_coordinates_is_null(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0)], POINT)
    assert {(r.id, r.target) for r in spatial.nearest(p, p.limit(0), 1.0).collect()} == {(1, None), (2, None), (3, None)}
    far = spark.createDataFrame([(9, 5.0, 0.0)], POINT)
    assert {r.id: r.target for r in spatial.nearest(p, far, 1.0, most=3.0).collect()} == {1: None, 2: None, 3: None}


def test_nearest_of_a_far_dense_place_meets_brute_force(spark):
    r = random.Random(7)
    p = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(40)] + [(100, 300.0, 0.0), (101, 0.1, 0.1)]
    t = [(i, 200 + r.uniform(-1, 1), 90 + r.uniform(-1, 1)) for i in range(300)] + [(400, 300.0, 0.0), (401, 300.0, 0.0)]
    left, right = spark.createDataFrame(p, POINT), spark.createDataFrame(t, POINT)
    for most in (None, 219.0):
        made = {r.id: (r.target, r.dist) for r in spatial.nearest(left, right, 0.05, most=most).collect()}
        assert len(made) == len(p)
        for i, x, y in p:
            d, k = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in t)
            assert made[i] == ((k, pytest.approx(d)) if most is None or d <= most else (None, None))


def test_nearest_other_than_itself_meets_brute_force(spark):
    p = [*scattered(30, 8), (70, 500.0, 500.0), (71, 900.0, 500.0)]
    df = spark.createDataFrame(p, POINT)
    made = {r.id: r.target for r in spatial.nearest(df, df, 0.1, itself=False).collect()}
    assert made == {i: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in p if j != i)[1] for i, x, y in p}
    assert spatial.nearest(df.limit(1), df.limit(1), 0.1, itself=False).first().target is None


def test_nearest_of_many_at_one_place_meets_few(spark):
    p = [(i, float(i % 7), float(i % 3)) for i in range(400)] + [(900, 3.3, 0.2)]
    t = [(i, float(i % 5), float(i % 2)) for i in range(300)] + [(900, 3.3, 0.0), (901, 3.3, 0.0)]
    left, right = spark.createDataFrame(p, POINT), spark.createDataFrame(t, POINT)
    for itself in (True, False):
        made = {r.id: (r.target, r.dist) for r in spatial.nearest(left, right, 50.0, itself=itself).collect()}
        best = {i: min((math.hypot(x - a, y - b), j) for j, a, b in t if itself or i != j) for i, x, y in p}
        assert {i: made[i][0] for i in made} == {i: best[i][1] for i in best}
    dense = spark.range(20000).select(F.col("id").alias("target"), (F.col("id") % 200 / 100).alias("ox"), (F.floor(F.col("id") / 200) / 100).alias("oy"))
    assert spatial._fine(dense, 1.0) == 1.0 / 64  # one for all would let each point meet 20,000


def test_points_of_a_far_place_meet_few_cells(spark):
    """However many targets stand in one far place, a point meets those of a few of its cells only."""
    near = [(i, 0.001 * i, 0.0) for i in range(50)]
    dense = [(i, 100 + 0.02 * (i % 60), 100 + 0.02 * (i // 60)) for i in range(3600)]
    p, t = spark.createDataFrame(near, POINT), spark.createDataFrame(dense, "target long, ox double, oy double")
    at = t.withColumns({"_bx": F.floor(F.col("ox") / 0.1), "_by": F.floor(F.col("oy") / 0.1)})
    met = spatial._open_cells(p, at, 0.1, None, True)[0].join(at, ["_bx", "_by"]).groupBy("id").count().agg(F.max("count")).first()[0]
    assert 0 < met <= 100


def test_within_meets_brute_force(spark):
    p = scattered(50, 3)
    df = spark.createDataFrame(p, POINT)
    want = {(i, j) for i, a, b in p for j, c, d in p if ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 1.0}
    assert {(r.id, r.other) for r in spatial.within(df, df, 1.0).collect()} == want


def test_point_in_ring_with_a_bite(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    poly = spark.createDataFrame([("p", [{"x": x, "y": y} for x, y in ring])], "name string, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 9.0, 9.0)], POINT)
    assert {r.id: r.name for r in spatial.in_polygon(p, poly, 1.5).collect()} == {1: "p", 2: None, 3: None}
    assert poly.select(geo.shoelace(F.col("ring")).alias("a")).first().a == pytest.approx(10.0)


RING = "name string, ring array<struct<x:double,y:double>>"


def test_cover_meets_the_plain_test(spark):
    """Random stars and rings on the lines of the buckets, with points on corners, edges and lines."""
    r = random.Random(5)
    rings = []
    for k in range(6):
        cx, cy, n = r.uniform(2, 8), r.uniform(2, 8), 5 + 4 * k
        ring = [(cx + r.uniform(0.3, 4) * math.cos(2 * math.pi * i / n), cy + r.uniform(0.3, 4) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        rings.append((f"star {k}", [*ring, ring[0]]))
    rings.append(("steps", [(1.0, 1.0), (6.0, 1.0), (6.0, 3.0), (4.0, 3.0), (4.0, 6.0), (1.0, 6.0), (1.0, 1.0)]))
    poly = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in ring]) for n, ring in rings], RING)
    p = spark.createDataFrame(scattered(400, 6) + [(1000 + 13 * i + j, i / 2, j / 2) for i in range(13) for j in range(13)], POINT)
    plain = p.crossJoin(poly).where(geo.inside(F.col("ring"), F.col("x"), F.col("y"))).groupBy("id").agg(F.min("name").alias("name"))
    want = {r.id: r.name for r in p.select("id").join(plain, "id", "left").collect()}
    for width in (0.5, 1.0, 3.7):
        assert {r.id: r.name for r in spatial.in_polygon(p, poly, width).collect()} == want


def test_a_ring_of_many_corners_is_not_copied(spark):
    n = 100_000
    at = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(2 * math.pi / n) * (i % n))
    poly = spark.range(1).select(F.lit("disc").alias("name"), F.transform(at, lambda a: F.struct((5 + 4 * F.cos(a)).alias("x"), (5 + 4 * F.sin(a)).alias("y"))).alias("ring"))
    made = spatial.cover(poly, 0.25).agg(F.sum(F.size("edges")), F.count_if((F.size("edges") == 0) & F.col("corner")), F.count(F.lit(1))).first()
    assert n <= made[0] <= 1.1 * n
    assert made[1] > made[2] / 2
    hits = spatial.in_polygon(spark.createDataFrame(scattered(500, 9), POINT), poly, 0.25).where("name IS NOT NULL").collect()
    assert {r.id for r in hits} == {i for i, x, y in scattered(500, 9) if math.hypot(x - 5, y - 5) < 4}


def test_rings_of_one_name_make_holes(spark):
    square = lambda a, b: [{"x": x, "y": y} for x, y in [(a, a), (b, a), (b, b), (a, b), (a, a)]]
    poly = spark.createDataFrame([("p", square(0.0, 9.0)), ("p", square(3.0, 6.0)), ("empty", [])], RING)
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 4.5), (3, 8.0, 8.0), (4, None, 1.0)], POINT)
    assert {r.id: r.name for r in spatial.in_polygon(p, poly, 1.0).collect()} == {1: "p", 2: None, 3: "p", 4: None}


def test_hexagon_holds_its_points(spark):
    df = spark.createDataFrame(scattered(80, 4), POINT).withColumn("c", grid.cell(F.col("x"), F.col("y"), 0.8))
    cx, cy = grid.centre(F.col("c"), 0.8)
    away = df.select(F.sqrt((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2).alias("d")).agg(F.max("d")).first()[0]
    assert away <= 0.8 + 1e-9
    assert df.select(F.size(grid.disk(F.col("c"), 3)).alias("n")).first().n == 37


def test_ids_of_far_hexagons_differ_and_give_their_steps_back(spark):
    steps = [(-100_000, 524_298), (-99_999, -524_278), (0, 0), (-1, -1), (1 << 30, -(1 << 30)), (-3, 40_000_000)]
    at = spark.createDataFrame([(math.sqrt(3) * q + math.sqrt(3) / 2 * r, 1.5 * r) for q, r in steps], "x double, y double")
    made = at.select(grid.cell(F.col("x"), F.col("y"), 1.0).alias("c")).select("c", *grid.axial(F.col("c"))).collect()
    assert [(r[1], r[2]) for r in made] == steps and len({r.c for r in made}) == len(steps)


def test_ellipsoid_is_near_the_sphere(spark):
    ends = [F.lit(float(v)) for v in (77.2, 28.6, 72.8, 19.0)]
    r = spark.range(1).select(geo.ellipsoid_km(*ends).alias("e"), geo.haversine_km(*ends).alias("h")).first()
    assert r.e == pytest.approx(r.h, rel=0.006) and r.e != r.h


def test_components_of_a_chain_and_a_pair(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41)], "a long, b long")
    made = {r.v: r.c for r in graph.components(links).collect()}
    assert made == {i: 1 for i in range(1, 21)} | {40: 40, 41: 40}


def test_thinning_is_the_walk(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(20)) for i in range(40)]
    near = {(a, b) for a in range(40) for b in range(a) if r.random() < 0.1}
    kept: list[int] = []
    for i, _ in sorted(rows, key=lambda x: (-x[1], x[0])):
        if not any((max(i, k), min(i, k)) in near for k in kept):
            kept.append(i)
    made = graph.thinned(spark.createDataFrame(rows, "id long, priority long"), spark.createDataFrame(sorted(near), "a long, b long"))
    assert sorted(x.id for x in made.collect()) == sorted(kept)


def test_shortest_paths_stop_at_the_limit(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 9.0)], "a long, b long, length double")
    made = graph.shortest_paths(links, spark.createDataFrame([(1,)], "node_id long"), 6.0)
    assert {(r.node, r.dist) for r in made.collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}


def test_thinning_by_distance_is_the_walk(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(40) / 10, rnd.randrange(30) / 10, rnd.choice("ab"), rnd.randrange(9)) for i in range(500)] + [(900, None, 1.0, "a", 9), (901, 1.0, 1.0, None, 9)]
    df = spark.createDataFrame(rows, "id long, x double, y double, mode string, priority long")
    for per in ((), ("mode",)):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[4], r[0])):
            alone = r[1] is None or per and r[3] is None
            if alone or not any(k[1] is not None and math.sqrt((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2) <= 0.5 and (not per or r[3] == k[3]) for k in kept):
                kept.append(r)
        assert {r.id for r in graph.thinned_points(df, 0.5, per).collect()} == {r[0] for r in kept}


def test_nearest_alike_meets_brute_force(spark):
    rnd = random.Random(6)
    side = lambda n: [(i, rnd.randrange(40) / 4, rnd.randrange(30) / 4, rnd.choice(["a", "b", None])) for i in range(n)]
    p, t = side(200), side(60)
    made = {r.id: r.other for r in spatial.nearest_alike(*(spark.createDataFrame(s, POINT + ", city string") for s in (p, t)), 1.5, ("city",)).collect()}
    best = {i: min(((math.sqrt((x - a) ** 2 + (y - b) ** 2), -j) for j, a, b, d in t if c is not None and c == d), default=(9, 0)) for i, x, y, c in p}
    assert made == {i: -j for i, (d, j) in best.items() if d <= 1.5}
