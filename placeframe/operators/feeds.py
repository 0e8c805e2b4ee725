"""Transit feeds: tables of text columns, their checks, longest trips and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.functions import geo
from placeframe.operators import quality
from placeframe.operators.rank import first_per

Feed = dict[str, DataFrame]


def issues(feed: Feed, box: tuple[float, float, float, float]) -> DataFrame:
    """level, check, count of a feed with stops, routes, trips and stop_times; an error means that it can't be used."""
    stops, routes, trips, times = (feed[t] for t in ("stops", "routes", "trips", "stop_times"))
    found = []
    for name, key in (("stops", "stop_id"), ("routes", "route_id"), ("trips", "trip_id")):
        found += [quality.duplicates(feed[name], key), quality.issue("error", f"empty_{key}", feed[name].where(F.col(key) == ""))]
    return quality.all_of(
        *found,
        quality.issue("warning", "stop_bad_coordinates", stops.where(~geo.valid(F.col("stop_lon"), F.col("stop_lat"), box))),
        quality.orphans(trips, "route_id", routes, "trip_unknown_route"),
        quality.orphans(times, "trip_id", trips, "stop_time_unknown_trip"),
        quality.orphans(times, "stop_id", stops, "stop_time_unknown_stop"),
        quality.orphans(routes, "route_id", trips, "route_without_trips"),
    )


def longest_trips(feed: Feed) -> DataFrame:
    """route_id, trip_id, n_stops: the trip with most stop rows of each route, the smaller id on a tie."""
    n = feed["stop_times"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_stops"))
    return first_per(feed["trips"].select("route_id", "trip_id").distinct().join(n, "trip_id"), ["route_id"], F.desc("n_stops"), "trip_id").select("route_id", "trip_id", "n_stops")


def route_lines(feed: Feed, box: tuple[float, float, float, float]) -> DataFrame:
    """route_id, stops, path: the longest trip's good stops in order, for routes with two different places at least."""
    good = feed["stops"].where(geo.valid(F.col("stop_lon"), F.col("stop_lat"), box)).dropDuplicates(["stop_id"])
    good = good.select("stop_id", F.col("stop_lon").try_cast("double").alias("x"), F.col("stop_lat").try_cast("double").alias("y"))
    rows = feed["stop_times"].join(longest_trips(feed), "trip_id").join(good, "stop_id")
    seq = F.struct(F.col("stop_sequence").try_cast("int").alias("seq"), "stop_id", "x", "y")
    lines = rows.groupBy("route_id").agg(F.sort_array(F.collect_list(seq)).alias("path"))
    return lines.where(F.size(F.array_distinct(F.transform("path", lambda p: F.struct(p["x"], p["y"])))) >= 2).withColumn("stops", F.size("path"))


def not_monotonic(times: DataFrame) -> DataFrame:
    """trip_id of trips whose sequence, in the order of `ts`, falls or repeats."""
    w = W.partitionBy("trip_id").orderBy("ts", "stop_id")
    step = times.withColumn("_before", F.lag(F.col("stop_sequence").try_cast("int")).over(w))
    return step.where(F.col("stop_sequence").try_cast("int") <= F.col("_before")).select("trip_id").distinct()


def accepted(feed: Feed, box: tuple[float, float, float, float], most_bad: float = 0.05) -> dict[str, DataFrame]:
    """stops, routes, issues and summary of many feeds at once; each table has a column `feed`.

    A feed with a repeated or empty id, without stops, or with a larger share of stops off the box than `most_bad` is left
    out whole. issues: feed, check, count; summary: feed, stops, bad, share, accepted.
    """
    found = []
    for name, key in (("stops", "stop_id"), ("routes", "route_id")):
        each = feed[name].groupBy("feed", key).agg(F.count(F.lit(1)).alias("n"))
        sums = each.groupBy("feed").agg(F.sum(F.col("n") - 1).alias(f"duplicate_{key}"), F.coalesce(F.sum(F.when(F.coalesce(key, F.lit("")) == "", F.col("n"))), F.lit(0)).alias(f"empty_{key}"))
        checks = [x for c in (f"duplicate_{key}", f"empty_{key}") for x in (F.lit(c), F.col(c))]
        found.append(sums.select("feed", F.explode(F.create_map(*checks)).alias("check", "count")).where("count > 0"))
    issues_ = quality.all_of(*found)
    bad = F.count_if(~geo.valid(F.col("stop_lon"), F.col("stop_lat"), box))
    counts = feed["stops"].groupBy("feed").agg(F.count(F.lit(1)).alias("stops"), bad.alias("bad")).withColumn("share", F.col("bad") / F.col("stops"))
    names = feed["routes"].select("feed").union(feed["stops"].select("feed")).distinct()
    failed = issues_.select("feed").distinct().withColumn("failed", F.lit(True))
    good = F.coalesce(F.col("share") <= most_bad, F.lit(False)) & F.col("failed").isNull()
    summary = names.join(counts, "feed", "left").join(failed, "feed", "left").select("feed", F.coalesce("stops", F.lit(0)).alias("stops"), F.coalesce("bad", F.lit(0)).alias("bad"), "share", good.alias("accepted"))
    kept = summary.where("accepted").select("feed")
    return {"stops": feed["stops"].join(kept, "feed", "left_semi"), "routes": feed["routes"].join(kept, "feed", "left_semi"), "issues": issues_, "summary": summary}
