"""Sub-scores, rounding and area scores as column expressions: no shuffle and no Python per row."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeframe.config import LARGE_PEOPLE, METRO_PEOPLE, Factor, Scoring



def zero() -> Column:
    return F.lit(0.0)



def observed(value: Column) -> Column:
    """NaN is not observed, as null is."""
    return F.when(~F.isnan(value), value)


def subscore(factor: Factor, value: Column) -> Column:
    """Straight lines between the knots, level outside them; null stays null."""
    (first, low), *_ = factor.bands
    _, high = factor.bands[-1]
    value = observed(value.cast("double"))
    out = F.when(value <= F.lit(float(first)), F.lit(float(low)))
    for (x0, y0), (x1, y1) in pairwise(factor.bands):
        out = out.when(value <= F.lit(float(x1)), F.lit(float(y0)) + (value - F.lit(float(x0))) / F.lit(float(x1) - float(x0)) * F.lit(float(y1) - float(y0)))
    return F.when(value.isNotNull(), out.otherwise(F.lit(float(high))))


def published(value: Column, digits: int) -> Column:
    """Half-even rounding, and no negative zero."""
    return F.bround(value, digits) + F.lit(0.0)


def half_away(value: Column, digits: int) -> Column:
    """Half away from zero by the number as stored: 0.5005, which is held as a little less, gives 0.5 for three digits."""
    size = F.abs(value) * 10.0**digits
    whole = F.floor(size)
    return F.signum(value) * (whole + (size - whole >= 0.5).cast("int")) / 10.0**digits


def delta(value: Column) -> Column:
    """Half away from zero, one decimal."""
    return F.round(value, 1)


def tier(people: Column) -> Column:
    return F.when(people >= METRO_PEOPLE, "metro").when(people >= LARGE_PEOPLE, "large").when(people.isNotNull(), "emerging")


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns, zero())


def area_score(cfg: Scoring, preset: str, sub: dict[str, Column]) -> dict[str, Column]:
    """Columns of one area under one preset: score, access, momentum, coverage, confidence and p_<factor> (points).

    Factors that are null or weigh nothing are left out and the other weights scaled up; all is null where none is left.
    """
    weights = {f: w for f, w in cfg.presets[preset].items() if w > 0}
    seen = {f: F.when(sub[f].isNotNull(), F.lit(w)).otherwise(zero()) for f, w in weights.items()}
    coverage = _total(list(seen.values()))
    whole = F.when(coverage > 0, coverage)
    points = {f: F.when(sub[f].isNotNull(), F.lit(w) * sub[f] / whole) for f, w in weights.items()}
    access = [f.name for f in cfg.factors if f.group == "access" and f.name in weights]
    access_weight = _total([seen[f] for f in access])
    momentum = [sub[f.name] for f in cfg.factors if f.group == "momentum"]
    count = _total([F.when(m.isNotNull(), 1.0).otherwise(0.0) for m in momentum])
    return {
        "score": F.when(whole.isNotNull(), _total([F.coalesce(p, zero()) for p in points.values()])),
        "access": F.when(whole.isNotNull() & (access_weight > 0), _total([F.coalesce(F.lit(weights[f]) * sub[f], zero()) for f in access]) / access_weight),
        "momentum": F.when(whole.isNotNull() & (count > 0), _total([F.coalesce(m, zero()) for m in momentum]) / count),
        "coverage": whole,
        "confidence": F.lit(cfg.confidence) * whole,
    } | {f"p_{f}": points.get(f, F.lit(None).cast("double")) for f in cfg.names}


def drivers(cfg: Scoring, points: dict[str, Column], sub: dict[str, Column]) -> Column:
    """The factors that carry a score: most points first, then by name."""
    each = [F.when(points[f].isNotNull() & (sub[f] >= cfg.driver_least), F.struct((-points[f]).alias("key"), F.lit(f).alias("factor"))) for f in cfg.names]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, cfg.max_drivers), lambda e: e["factor"])


def gaps(cfg: Scoring, preset: str, points: dict[str, Column], sub: dict[str, Column]) -> Column:
    """The factors that hold a score back: largest weighted shortfall first, then by name."""
    w = cfg.presets[preset]
    each = [
        F.when(points[f].isNotNull() & (sub[f] < cfg.gap_most), F.struct((-F.lit(w[f]) * (100 - sub[f])).alias("key"), F.lit(f).alias("factor")))
        for f in cfg.names
    ]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, cfg.max_gaps), lambda e: e["factor"])


def explanation(cfg: Scoring, kind: str, factor: Column, value: Column, share: Column) -> Column:
    """struct(key, km, pct, pp): which sentence tells of a driver ('why') or gap ('gap'), and its numbers.

    Factors with a headline distance: the share of residents within it ('none' if it rounds to 0), else near or, beyond the
    last knot, far. Half rounds up.
    """
    half_up = lambda v, by: F.floor(v * by + 0.5) / by
    name = lambda *end: F.concat_ws(".", F.lit(kind), factor, *[F.lit(x) for x in end])
    out, empty = None, F.lit(None).cast("double")

    def said(key: Column, km: Column = empty, pct: Column = empty, pp: Column = empty) -> Column:
        return F.struct(key.alias("key"), km.cast("double").alias("km"), pct.cast("double").alias("pct"), pp.cast("double").alias("pp"))

    unknown = said(name("unknown"))
    for f in cfg.factors:
        own = factor == f.name
        if f.headline_km is not None:
            last, near = F.lit(float(f.bands[-1][0])), F.lit(float(f.headline_km))
            pct = half_up(share * 100, 1)
            each = F.when(pct == 0, said(name("none"), km=near)).when(share.isNotNull(), said(name("share"), km=near, pct=pct))
            each = each.when(value > last, said(name("far"), km=last)).when(value.isNotNull(), said(name("near"), km=half_up(value, 10)))
        elif f.unit == "pp":
            pp = half_up(value, 1)
            each = F.when(F.abs(pp) == 1, said(name("one"), pp=pp)).when(value.isNotNull(), said(name(), pp=pp))
        else:
            each = F.when(value.isNotNull(), said(name(), km=half_up(value, 10)))
        out = F.when(own, each.otherwise(unknown)) if out is None else out.when(own, each.otherwise(unknown))
    return out.otherwise(unknown)
