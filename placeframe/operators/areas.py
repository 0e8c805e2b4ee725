"""Areas and cities as jobs: names, facts, documents, and how firm a ranking is when its weights move."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.config import Scoring
from placeframe.functions import scoring as S
from placeframe.operators import score, spatial
from placeframe.operators.rank import first_per


def named(cells: DataFrame, places: DataFrame, most: float, width: float) -> DataFrame:
    """cell, name for cells(cell, x, y): the best of places(id, cell, x, y, rank, name) inside, else the nearest within `most`.

    Inside, the lower rank wins, then the nearer to the centre, then the name. Places without a rank or name name nothing.
    """
    own = cells.select("cell", F.col("x").alias("cx"), F.col("y").alias("cy"))
    usable = places.where("rank IS NOT NULL AND name IS NOT NULL")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    key = F.struct("rank", F.sqrt(dx * dx + dy * dy).alias("dist"), "name")
    inside = usable.join(own, "cell").groupBy("cell").agg(F.min(key).alias("best")).select("cell", F.col("best.name").alias("inside"))
    bare = cells.join(inside, "cell", "left_anti").select(F.col("cell").alias("id"), "x", "y")
    near = spatial.nearest(bare, usable.select("id", "x", "y"), width, most).join(usable.select(F.col("id").alias("target"), F.col("name").alias("near")), "target")
    out = cells.select("cell").join(inside, "cell", "left").join(near.select(F.col("id").alias("cell"), "near"), "cell", "left")
    return out.select("cell", F.coalesce("inside", "near").alias("name"))


def facts(cells: DataFrame, targets: dict[str, DataFrame], places: DataFrame, least_people: float, most: float, width: float) -> DataFrame:
    """cells(cell, x, y, people, ...) with people enough, each with its name and <kind>_dist to the nearest target of each kind."""
    kept = cells.where(F.col("people") >= least_people)
    out = kept
    for kind, there in targets.items():
        near = spatial.nearest(kept.select(F.col("cell").alias("id"), "x", "y"), there, width)
        out = out.join(near.select(F.col("id").alias("cell"), F.col("dist").alias(f"{kind}_dist")), "cell", "left")
    return out.join(named(kept, places, most, width), "cell")


def without_areas(cities: DataFrame, members: DataFrame) -> DataFrame:
    """city of the cities that no area belongs to; a job reports them as an error."""
    return cities.select("city").join(members.select("city"), "city", "left_anti")


def documents(members: DataFrame, cfg: Scoring, preset: str, sources: DataFrame) -> DataFrame:
    """city and doc: a struct of its scores, best area, factors by name, and the licences of sources(city, licence).

    What a document nests is bounded by the number of factors and of licences. An area's document is its own row, see
    scored_areas(); a city's areas are never gathered.
    """
    scores = score.city_scores(members, cfg, preset)
    best = score.best_areas(members, cfg.best_area_people).select("city", F.col("cell").alias("best"))
    entry = F.struct("factor", F.struct("value", "share"))
    factors = score.factor_summary(members, cfg).groupBy("city").agg(F.map_from_entries(F.collect_list(entry)).alias("factors"))
    licences = sources.groupBy("city").agg(F.sort_array(F.collect_set("licence")).alias("licences"))
    whole = scores.join(best, "city", "left").join(factors, "city", "left").join(licences, "city", "left")
    body = F.struct(S.published(F.col("score"), 1).alias("score"), S.published(F.col("coverage"), 2).alias("coverage"), "people", "areas", "best", "factors", "licences", "drivers", "gaps")
    return whole.select("city", body.alias("doc"))


def draws(cfg: Scoring, count: int, spread: float, seed: int) -> list[tuple[str, int, list[float]]]:
    """(preset, draw, weights in the order of cfg.names); draw 0 has the preset's own, the others move each by up to the spread."""
    random, out = np.random.default_rng(seed), []
    for preset, weights in cfg.presets.items():
        own = np.array([weights[f] for f in cfg.names])
        out.append((preset, 0, own.tolist()))
        for i, by in enumerate(random.uniform(1 - spread, 1 + spread, (count, len(own)))):
            out.append((preset, i + 1, (own * by / (own * by).sum()).tolist()))
    return out


def sensitivity(members: DataFrame, cfg: Scoring, weightings: list[tuple[str, int, list[float]]], top: int) -> DataFrame:
    """preset, retention: the mean share of each state's first cities that stay so when the weights move.

    members(state, city, pop and each factor's raw value). A score under any weights needs only the sums of pop and of
    pop by sub-score over the areas that observed the same factors, so areas are added up by city and by what they
    observed (at most 2 ** factors rows a city) before they meet the weightings, whose number is a parameter.
    """
    names = cfg.names
    subs = members.select("state", "city", "pop", *[S.subscore(f, F.col(f.name)).alias(f.name) for f in cfg.factors])
    seen = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(names)), F.lit(0))
    sums = [F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col("pop")).alias(f) for f in names]
    held = subs.withColumn("seen", seen).groupBy("state", "city", "seen").agg(F.sum("pop").alias("pop"), *sums)
    table = json.dumps([{"preset": p, "draw": d, "w": w} for p, d, w in weightings])
    each = held.withColumn("t", F.explode(F.from_json(F.lit(table), "array<struct<preset: string, draw: int, w: array<double>>>")))
    w = [F.get(F.col("t.w"), i) for i in range(len(names))]
    over = sum((F.when(F.col("seen").bitwiseAND(F.lit(1 << i)) > 0, w[i]).otherwise(0.0) for i in range(len(names))), F.lit(0.0))
    part = sum((w[i] * F.col(f) for i, f in enumerate(names)), F.lit(0.0))
    rated = each.where(over > 0).groupBy("t.preset", "t.draw", "state", "city").agg((F.sum(part / over) / F.sum("pop")).alias("score"))
    place = F.row_number().over(W.partitionBy("preset", "draw", "state").orderBy(F.desc("score"), "city"))
    first = rated.withColumn("place", place).where(F.col("place") <= top).select("preset", "draw", "state", "city")
    base = first.where("draw = 0").drop("draw").withColumn("own", F.lit(1))
    stay = first.where("draw > 0").join(base, ["preset", "state", "city"], "left").groupBy("preset", "draw", "state")
    return stay.agg((F.count("own") / F.count(F.lit(1))).alias("share")).groupBy("preset").agg(F.avg("share").alias("retention"))


def stations(listed: DataFrame, mapped: DataFrame, twin: float, apart: float) -> DataFrame:
    """id, mode, key, x, y, source: the stations of both tables (id, mode, key, x, y), each place once for its mode.

    A listed station with a mapped one of its mode and key within `twin` is the same and goes. Of what is left, a walk
    from the mapped ones on, by id, keeps a station and drops those of its mode within `apart`. Ids are unique in a table.
    """
    from placeframe.operators.graph import thinned_points

    twins = spatial.nearest_alike(listed.select("id", "x", "y", "mode", "key"), mapped.select("id", "x", "y", "mode", "key"), twin, ("mode", "key")).select("id")
    both = mapped.withColumn("source", F.lit("mapped")).unionByName(listed.join(twins, "id", "left_anti").withColumn("source", F.lit("listed")))
    key = F.col("id") * 2 + (F.col("source") == "listed").cast("int")
    own = both.withColumns({"_id": key, "priority": F.when(F.col("source") == "mapped", 1).otherwise(0)})
    kept = thinned_points(own.select(F.col("_id").alias("id"), "x", "y", "mode", "priority"), apart, ("mode",))
    return own.join(kept.select(F.col("id").alias("_id")), "_id", "left_semi").select("id", "mode", "key", "x", "y", "source")


def standard_columns(rows: DataFrame, missing: tuple[str, ...] = ("", "na", "n/a", "null", "none", "-")) -> DataFrame:
    """Columns as text under plain names: lower case, letters and digits, _2, _3 on a repeated one; missing marks are null."""
    import re

    seen: dict[str, int] = {}
    names = []
    for c in rows.columns:
        plain = re.sub("[^a-z0-9]+", "_", c.lower()).strip("_") or "column"
        seen[plain] = seen.get(plain, 0) + 1
        names.append(plain if seen[plain] == 1 else f"{plain}_{seen[plain]}")
    out = rows.toDF(*[f"c{i}" for i in range(len(names))])
    text = lambda i: F.trim(F.col(f"c{i}").cast("string"))
    return out.select(*[F.when(~F.lower(text(i)).isin(*missing), text(i)).alias(n) for i, n in enumerate(names)])


def below_header(lines: DataFrame, least: int = 3) -> DataFrame:
    """file, line, values (header -> cell) of lines(file, line, cells) below each file's header.

    The header is the first line with `least` cells or more that hold something, else the file's first line. Blank cells
    are null; cells under a blank header, and of a repeated header all but the first, are left out.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = lines.select("file", "line", F.transform("cells", blank).alias("cells"))
    enough = F.when(F.size(F.filter("cells", lambda c: c.isNotNull())) >= least, F.col("line"))
    at = own.groupBy("file").agg(F.coalesce(F.min(enough), F.min("line")).alias("at"))
    header = own.join(at, "file").where("line = at").select("file", "at", F.col("cells").alias("header"))
    below = own.join(header, "file").where("line > at")
    named = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("h"), F.get("cells", i).alias("c"), (F.array_position("header", h) == i + 1).alias("own"))), lambda p: p["h"].isNotNull() & p["own"])
    return below.select("file", "line", F.map_from_entries(F.transform(named, lambda p: F.struct(p["h"], p["c"]))).alias("values"))
