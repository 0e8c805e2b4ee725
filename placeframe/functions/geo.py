"""Geometry as arithmetic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean radius of the earth in km, km of a degree, and the reference ellipsoid's axis and flattening.
EARTH_KM, DEGREE_KM = 6371.0088, 111.2
AXIS_KM, FLATTENING = 6378.137, 1 / 298.257223563


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def flat_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(DEGREE_KM) * F.sqrt(dx * dx + (lat2 - lat1) * (lat2 - lat1))


def ellipsoid_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length on the ellipsoid to first order in the flattening (Andoyer and Lambert); within some metres below 1000 km."""
    f, g, l = (F.radians(x) / 2 for x in (lat1 + lat2, lat1 - lat2, lon1 - lon2))
    sin2 = lambda x: F.sin(x) * F.sin(x)
    cos2 = lambda x: F.cos(x) * F.cos(x)
    s = sin2(g) * cos2(l) + cos2(f) * sin2(l)
    c = cos2(g) * cos2(l) + sin2(f) * sin2(l)
    w = F.atan2(F.sqrt(s), F.sqrt(c))
    r = F.sqrt(s * c) / w
    h1, h2 = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
    return F.when(s == 0, 0.0).otherwise(2 * w * AXIS_KM * (1 + FLATTENING * (h1 * sin2(f) * cos2(g) - h2 * cos2(f) * sin2(g))))


def with_ellipsoid_km(rows: DataFrame, name: str, *ends: str) -> DataFrame:
    """rows with ellipsoid_km() of four columns. Each step is exploded, as an array of one: a column of its own, which is
    worked out once and not wherever it is used."""
    lon1, lat1, lon2, lat2 = (F.col(c) for c in ends)
    halves = {"_f": lat1 + lat2, "_g": lat1 - lat2, "_l": lon1 - lon2}
    for k, v in halves.items():
        half = F.radians(v) / 2
        for i, turn in (("s", F.sin), ("c", F.cos)):
            rows = rows.withColumn(f"{k}{i}", F.explode(F.array(turn(half))))
    sq = {c: F.col(c) * F.col(c) for c in ("_fs", "_fc", "_gs", "_gc", "_ls", "_lc")}
    rows = rows.withColumn("_a", F.explode(F.array(sq["_gs"] * sq["_lc"] + sq["_fc"] * sq["_ls"])))
    rows = rows.withColumn("_b", F.explode(F.array(sq["_gc"] * sq["_lc"] + sq["_fs"] * sq["_ls"])))
    rows = rows.withColumn("_w", F.explode(F.array(F.atan2(F.sqrt("_a"), F.sqrt("_b")))))
    rows = rows.withColumn("_r", F.explode(F.array(F.sqrt(F.col("_a") * F.col("_b")) / F.nullif(F.col("_w"), F.lit(0.0)))))
    h1, h2 = (3 * F.col("_r") - 1) / (2 * F.col("_b")), (3 * F.col("_r") + 1) / (2 * F.col("_a"))
    km = F.when(F.col("_a") == 0, 0.0).otherwise(2 * F.col("_w") * AXIS_KM * (1 + FLATTENING * (h1 * sq["_fs"] * sq["_gc"] - h2 * sq["_fc"] * sq["_gs"])))
    return rows.withColumn(name, F.explode(F.array(km))).drop(*sq, "_a", "_b", "_w", "_r")


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / length2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    px, py = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(px * px + py * py)


def shoelace(ring: Column) -> Column:
    """Area of a closed ring, an array of structs x, y whose last is its first."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    hits = F.aggregate(F.transform(F.sequence(F.lit(0), n - 2), crosses), F.lit(0), lambda a, v: a + v)
    return hits % 2 == 1


def pixel(value: Column, origin: float, step: float, size: int) -> Column:
    """Index of the pixel that holds a coordinate; null off the grid or where not finite."""
    at = F.floor((value - F.lit(origin)) / F.lit(step))
    return F.when(~F.isnan(value) & (at >= 0) & (at < size), at)


def valid(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Both are numbers and inside (least lon, least lat, most lon, most lat)."""
    x, y = lon.try_cast("double"), lat.try_cast("double")
    return F.coalesce(x.between(box[0], box[2]) & y.between(box[1], box[3]), F.lit(False))


def snapped(coords: Column, digits: int = 4) -> Column:
    return F.transform(coords, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


# The national conic projection of the public registry: two standard parallels, origin and offset in m.
CONIC = (12.472955, 35.1728044444444, 24.0, 80.0, 4_000_000.0)


def conic_terms(parallels: tuple[float, float, float, float, float] = CONIC) -> tuple[float, float, float, float]:
    """n, scale, radius at the origin in m and eccentricity of a conformal conic projection of the ellipsoid."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    p1, p2, p0 = (math.radians(v) for v in parallels[:3])
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    scale = AXIS_KM * 1000 * m(p1) / (n * t(p1) ** n)
    return n, scale, scale * t(p0) ** n, e


def conic(lon: Column, lat: Column, parallels: tuple[float, float, float, float, float] = CONIC) -> tuple[Column, Column]:
    """East and north in m on a conformal conic projection."""
    n, scale, origin, e = conic_terms(parallels)
    p = F.radians(lat)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    r, turn = scale * F.pow(t, F.lit(n)), n * F.radians(lon - parallels[3])
    return parallels[4] + r * F.sin(turn), parallels[4] + origin - r * F.cos(turn)


def conic_inverse(east: Column, north: Column, parallels: tuple[float, float, float, float, float] = CONIC) -> tuple[Column, Column]:
    """Degrees of a place on `conic`: the conformal latitude, then its series to the ellipsoid's."""
    n, scale, origin, e = conic_terms(parallels)
    dx, dy = east - parallels[4], parallels[4] + origin - north
    r = F.sqrt(dx * dx + dy * dy)
    turn = F.atan2(dx * math.copysign(1, n), dy * math.copysign(1, n))
    p = math.pi / 2 - 2 * F.atan(F.pow(r / abs(scale), F.lit(1 / n)))
    e2, e4, e6, e8 = (e**k for k in (2, 4, 6, 8))
    terms = [e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280]
    return parallels[3] + F.degrees(turn) / n, F.degrees(_series(p, terms))


def _series(p: Column, terms: list[float]) -> Column:
    """p + a sin 2p + b sin 4p + ..."""
    return sum((a * F.sin(2 * k * p) for k, a in enumerate(terms, 1)), p)


# The equal-area conic projection of southern Asia: two standard parallels, origin.
EQUAL_AREA = (7.0, -32.0, -15.0, 125.0)


def equal_area_terms(parallels: tuple[float, float, float, float] = EQUAL_AREA) -> tuple[float, float, float, float]:
    """n, constant, radius at the origin in km and eccentricity of an equal-area conic projection of the ellipsoid."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    p1, p2, p0 = (math.radians(v) for v in parallels[:3])
    m2 = lambda p: math.cos(p) ** 2 / (1 - (e * math.sin(p)) ** 2)
    q = lambda p: (1 - e * e) * (math.sin(p) / (1 - (e * math.sin(p)) ** 2) + math.atanh(e * math.sin(p)) / e)
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    constant = m2(p1) + n * q(p1)
    return n, constant, AXIS_KM * math.sqrt(constant - n * q(p0)) / n, e


def equal_area(lon: Column, lat: Column, parallels: tuple[float, float, float, float] = EQUAL_AREA) -> tuple[Column, Column]:
    """East and north in km on an equal-area conic projection: areas of rings on it are areas of the ellipsoid."""
    n, constant, origin, e = equal_area_terms(parallels)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
    r, turn = F.sqrt(constant - n * q) * (AXIS_KM / n), n * F.radians(lon - parallels[3])
    return r * F.sin(turn), origin - r * F.cos(turn)


def equal_area_inverse(east: Column, north: Column, parallels: tuple[float, float, float, float] = EQUAL_AREA) -> tuple[Column, Column]:
    """Degrees of a place on `equal_area`: the authalic latitude, then its series to the ellipsoid's, to 1e-7 degrees (a centimetre)."""
    n, constant, origin, e = equal_area_terms(parallels)
    sign = math.copysign(1, n)
    dx, dy = east * sign, (origin - north) * sign
    q = (constant - (dx * dx + dy * dy) * (n / AXIS_KM) ** 2) / n
    pole = 1 + (1 - e * e) * math.atanh(e) / e
    e2, e4, e6 = (e**k for k in (2, 4, 6))
    terms = [e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360]
    beta = F.asin(F.least(F.greatest(q / pole, F.lit(-1.0)), F.lit(1.0)))
    return parallels[3] + F.degrees(F.atan2(dx, dy)) / n, F.degrees(_series(beta, terms))


def ring_km2(ring: Column) -> Column:
    """Area in km2 of a closed ring of structs x (degrees east) and y (degrees north), its corners joined straight on `equal_area`."""
    return shoelace(F.transform(ring, lambda p: F.struct(*[v.alias(c) for v, c in zip(equal_area(p["x"], p["y"]), "xy", strict=True)])))
