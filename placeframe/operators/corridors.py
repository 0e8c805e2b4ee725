"""What goes with nearness to lines: growth in rings around corridors, events snapped to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.operators import spatial


def ring_effect(cells: DataFrame, corridors: DataFrame, near: float, far: float, treated: str, width: float) -> DataFrame:
    """group, near, far, near_median, far_median, n_near, n_far, near_minus_far, effect: growth around corridors.

    cells(id, x, y, before, after): a panel of two epochs; a cell without both is left out. corridors(group, segment, a,
    b). A cell is near when its nearest line of a group is at most `near` away, far when at most `far`; one in rings of
    several groups counts once, for the first by name. effect: near_minus_far of `treated` less that of the first other
    group by name, in each row; null if a ring is empty.
    """
    panel = cells.where("before IS NOT NULL AND after IS NOT NULL").select("id", "x", "y", (F.col("after") - F.col("before")).alias("growth"))
    groups = corridors.select("group").distinct()
    placed = spatial.nearest_segment(panel, corridors, far, width, per=("group",))
    once = placed.groupBy("id").agg(F.min(F.struct("group", "dist")).alias("r")).select("id", "r.*")
    ring = once.join(panel.select("id", "growth"), "id").withColumn("ring", F.when(F.col("dist") <= near, "near").otherwise("far"))
    in_ring = lambda r: F.when(F.col("ring") == r, F.col("growth"))
    made = [f(in_ring(r)).alias(f"{r}{tail}") for r in ("near", "far") for f, tail in ((F.avg, ""), (F.median, "_median"))]
    made += [F.count_if(F.col("ring") == r).alias(f"n_{r}") for r in ("near", "far")]
    rows = groups.join(ring.groupBy("group").agg(*made), "group", "left").withColumn("near_minus_far", F.col("near") - F.col("far"))
    rows = rows.fillna(0, ["n_near", "n_far"])
    gap = lambda own: F.min(F.when(own, F.struct("group", "near_minus_far")))["near_minus_far"]
    effect = rows.agg((gap(F.col("group") == treated) - gap(F.col("group") != treated)).alias("effect"))
    return rows.crossJoin(F.broadcast(effect))  # one row


def event_rates(events: DataFrame, lines: DataFrame, snap: float, years: float, width: float) -> DataFrame:
    """class, km, events, weight, events_per_100km, weight_per_100km, snapped_share: a year's rates by class of line.

    events(id, x, y, weight) belong to the nearest of lines(segment, class, km, a, b) if it is within `snap`; km are those
    of all lines of a class. A class without events has 0; snapped_share is of all events, in each row.
    """
    near = spatial.nearest_segment(events, lines.select("segment", "a", "b"), snap, width).select("id", "segment")
    each = near.join(events.select("id", "weight"), "id").join(lines.select("segment", "class"), "segment")
    counts = each.groupBy("class").agg(F.count(F.lit(1)).alias("events"), F.sum("weight").alias("weight"))
    rows = lines.groupBy("class").agg(F.sum("km").alias("km")).join(counts, "class", "left").fillna(0, ["events", "weight"])
    per = lambda c: F.col(c) * 100 / F.nullif(F.col("km"), F.lit(0.0)) / years
    rows = rows.withColumns({"events_per_100km": per("events"), "weight_per_100km": per("weight")})
    all_ = events.agg(F.count(F.lit(1)).alias("_all"))
    snapped = rows.agg(F.sum("events").alias("_snapped")).crossJoin(F.broadcast(all_))  # one row
    share = snapped.select((F.col("_snapped") / F.nullif(F.col("_all"), F.lit(0))).alias("snapped_share"))
    return rows.crossJoin(F.broadcast(share))  # one row
