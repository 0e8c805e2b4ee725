from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from placeframe.functions import geo
from placeframe.operators import corridors, spatial

POINT = "id long, x double, y double"
LINE = "segment long, a struct<x:double,y:double>, b struct<x:double,y:double>"


def away(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = min(max(((x - a[0]) * dx + (y - a[1]) * dy) / n, 0), 1) if n else 0
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def test_projections_are_undone_by_their_inverses(spark):
    places = spark.createDataFrame([(68.5, 6.5), (80.0, 24.0), (97.0, 37.0), (74.2, 19.9)], "lon double, lat double")
    for there, back, most in ((geo.conic, geo.conic_inverse, 1e-8), (geo.equal_area, geo.equal_area_inverse, 1e-7)):
        for r in places.select("lon", "lat", *back(*there(F.col("lon"), F.col("lat")))).collect():
            assert (r[2], r[3]) == (pytest.approx(r[0], abs=most), pytest.approx(r[1], abs=most))


def test_ring_has_the_area_of_the_ellipsoid(spark):
    """A cell between two meridians and two parallels, with many corners, against the closed form of its area."""
    e = math.sqrt(geo.FLATTENING * (2 - geo.FLATTENING))
    q = lambda lat: (1 - e * e) * (math.sin(lat) / (1 - (e * math.sin(lat)) ** 2) + math.atanh(e * math.sin(lat)) / e)
    for lon, lat in ((68.0, 6.0), (80.0, 24.0), (96.0, 36.0)):
        side = [i / 50 for i in range(50)]
        ring = [(lon + t, lat) for t in side] + [(lon + 1, lat + t) for t in side] + [(lon + 1 - t, lat + 1) for t in side] + [(lon, lat + 1 - t) for t in side] + [(lon, lat)]
        df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
        want = geo.AXIS_KM**2 / 2 * (q(math.radians(lat + 1)) - q(math.radians(lat))) * math.radians(1)
        sphere = geo.EARTH_KM**2 * (math.sin(math.radians(lat + 1)) - math.sin(math.radians(lat))) * math.radians(1)
        made = df.select(geo.ring_km2(F.col("ring"))).first()[0]
        assert made == pytest.approx(want, rel=1e-6)
        assert made == pytest.approx(sphere, rel=0.01)


def test_nearest_segment_meets_brute_force(spark):
    r = random.Random(3)
    at = lambda: (r.uniform(0, 10), r.uniform(0, 10))
    points = [(i, *at()) for i in range(80)]
    lines = [(k, at(), at()) for k in range(6)] + [(9, (1.0, 1.0), (1.0, 1.0))]
    df = spark.createDataFrame([*points, (500, None, 1.0)], POINT)
    segments = spark.createDataFrame([*lines, (10, None, (1.0, 1.0))], LINE)
    for most, width in ((0.4, 0.3), (1.5, 2.0)):
        want = {}
        for i, x, y in points:
            d, k = min((away(x, y, a, b), k) for k, a, b in lines)
            if d <= most:
                want[i] = (k, pytest.approx(d))
        assert {r.id: (r.segment, r.dist) for r in spatial.nearest_segment(df, segments, most, width).collect()} == want


def test_overlaps_of_discs(spark):
    discs = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 8.0, 0.0, 10.0), (3, 100.0, 0.0, 10.0), (4, None, 0.0, 10.0), (5, 0.0, 0.0, 2.0)], POINT + ", radius double")
    made = {(r.radius, r.times): r.area for r in spatial.overlaps(discs, 0.1).collect()}
    both = 2 * 100 * math.acos(0.4) - 4 * math.sqrt(400 - 64)
    assert made == {(10.0, 1): pytest.approx(3 * math.pi * 100 - 2 * both, rel=0.005), (10.0, 2): pytest.approx(both, rel=0.005), (2.0, 1): pytest.approx(math.pi * 4, rel=0.01)}
    assert spatial.overlaps(discs.limit(0), 1.0).count() == 0


def test_cell_in_rings_of_both_groups_counts_once(spark):
    cells = spark.createDataFrame(
        [(1, 0.0, 0.5, 1.0, 3.0), (2, 0.0, 1.5, 1.0, 2.0), (3, 0.0, 3.0, 0.0, 9.0), (4, 0.0, 5.5, 1.0, 1.5), (5, 0.0, 4.2, 1.0, 1.25), (6, 0.0, 0.1, None, 5.0), (7, 50.0, 0.0, 1.0, 2.0)],
        POINT + ", before double, after double",
    )
    lines = spark.createDataFrame([("opened", 1, (-1.0, 0.0), (1.0, 0.0)), ("later", 2, (-1.0, 6.0), (1.0, 6.0))], "group string, " + LINE)
    made = {r.group: r for r in corridors.ring_effect(cells, lines, 1.0, 3.0, "opened", 1.0).collect()}
    assert (made["opened"].n_near, made["opened"].n_far, made["later"].n_near, made["later"].n_far) == (1, 1, 1, 2)  # cell 3 is in both
    assert made["later"].far == pytest.approx((9.0 + 0.25) / 2) and made["opened"].far_median == 1.0
    assert made["opened"].near_minus_far == pytest.approx(1.0) and made["later"].near_minus_far == pytest.approx(0.5 - 4.625)
    assert [r.effect for r in made.values()] == [pytest.approx(1.0 - (0.5 - 4.625))] * 2
    empty = corridors.ring_effect(cells.limit(0), lines, 1.0, 3.0, "opened", 1.0).collect()
    assert [(r.n_near, r.near, r.effect) for r in empty] == [(0, None, None)] * 2


def test_rates_of_events_by_class(spark):
    events = spark.createDataFrame([(1, 0.0, 0.1, 2), (2, 0.5, 0.1, 3), (3, 0.0, 0.9, 1), (4, 0.0, 9.0, 7)], POINT + ", weight long")
    lines = spark.createDataFrame([("two", 40.0, 1, (-1.0, 0.0), (1.0, 0.0)), ("four", 50.0, 2, (-1.0, 1.0), (1.0, 1.0)), ("four", 30.0, 3, (-1.0, 30.0), (1.0, 30.0)), ("six", 10.0, 4, (0.0, 60.0), (1.0, 60.0))], "class string, km double, " + LINE)
    made = {r["class"]: r for r in corridors.event_rates(events, lines, 0.2, 2.0, 1.0).collect()}
    assert [(made[c].km, made[c].events, made[c].weight) for c in ("two", "four", "six")] == [(40.0, 2, 5), (80.0, 1, 1), (10.0, 0, 0)]
    assert made["two"].events_per_100km == pytest.approx(2 * 100 / 40 / 2) and made["four"].weight_per_100km == pytest.approx(100 / 80 / 2)
    assert {r.snapped_share for r in made.values()} == {0.75}
