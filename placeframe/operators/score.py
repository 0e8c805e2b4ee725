"""City scores and summaries from scored areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.config import Scoring
from placeframe.functions import scoring as S


def scored_areas(cells: DataFrame, cfg: Scoring, preset: str) -> DataFrame:
    """cells (one row an area, a column for each factor's raw value) with s_<factor>, the preset's scores and p_<factor>.

    Everything is computed from the row, so areas that several cities share are scored once and joined later.
    """
    out = cells.withColumns({f"s_{f.name}": S.subscore(f, F.col(f.name)) for f in cfg.factors})
    return out.withColumns(S.area_score(cfg, preset, {f: F.col(f"s_{f}") for f in cfg.names}))


def explained_areas(cells: DataFrame, cfg: Scoring, preset: str) -> DataFrame:
    """scored_areas() with the lists drivers and gaps."""
    out = scored_areas(cells, cfg, preset)
    points, sub = ({f: F.col(f"{x}_{f}") for f in cfg.names} for x in "ps")
    return out.withColumns({"drivers": S.drivers(cfg, points, sub), "gaps": S.gaps(cfg, preset, points, sub)})


def _weighted(value: str) -> F.Column:
    """Mean by pop over the rows where the value was observed."""
    return F.sum(F.col(value) * F.col("pop")) / F.sum(F.when(F.col(value).isNotNull(), F.col("pop")))


def city_scores(members: DataFrame, cfg: Scoring, preset: str) -> DataFrame:
    """A row for each city of members (city, pop and scored_areas() columns): population-weighted scores and points.

    A factor's points count as 0 in an area that hasn't got it, so that the city's points add up to its score; its
    sub-score is the mean over the areas that have it. Areas with no score at all are left out.
    """
    own = members.where(F.col("score").isNotNull())
    total = F.sum("pop")
    sums = [(F.sum(F.col(c) * F.col("pop")) / total).alias(c) for c in ("score", "coverage", "confidence")]
    sums += [_weighted(c).alias(c) for c in ("access", "momentum")]
    sums += [F.when(F.count(f"p_{f}") > 0, F.sum(F.coalesce(f"p_{f}", S.zero()) * F.col("pop")) / total).alias(f"p_{f}") for f in cfg.names]
    sums += [_weighted(f"s_{f}").alias(f"s_{f}") for f in cfg.names]
    out = own.groupBy("city").agg(total.alias("people"), F.count(F.lit(1)).alias("areas"), *sums)
    points, sub = ({f: F.col(f"{x}_{f}") for f in cfg.names} for x in "ps")
    return out.withColumns({"drivers": S.drivers(cfg, points, sub), "gaps": S.gaps(cfg, preset, points, sub)})


def lower_weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, median: the smallest value whose running weight reaches half the total; always a value that was observed.

    Equal values are added up first, so a group is sorted over its different values only.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    order = W.partitionBy(*by).orderBy(value)
    running = sums.withColumns({"_run": F.sum("_w").over(order), "_all": F.sum("_w").over(W.partitionBy(*by))})
    return running.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("median"))


def factor_summary(members: DataFrame, cfg: Scoring) -> DataFrame:
    """city, factor, value (weighted median), share (of residents inside the headline distance) of observed areas."""
    pairs = [x for f in cfg.factors for x in (F.lit(f.name), F.col(f.name).cast("double"))]
    km = {f.name: f.headline_km for f in cfg.factors if f.headline_km is not None}
    each = members.select("city", "pop", F.explode(F.create_map(*pairs)).alias("factor", "raw")).where("raw IS NOT NULL")
    limit = F.coalesce(*[F.when(F.col("factor") == f, F.lit(float(k))) for f, k in km.items()])
    shares = each.groupBy("city", "factor").agg(
        (F.sum(F.when(F.col("raw") <= limit, F.col("pop")).when(limit.isNotNull(), 0)) / F.sum("pop")).alias("share")
    )
    value = lower_weighted_median(each, ["city", "factor"], "raw", "pop")
    return value.join(shares, ["city", "factor"]).select("city", "factor", S.published(F.col("median"), 1).alias("value"), S.published(F.col("share"), 2).alias("share"))


def best_areas(members: DataFrame, least_people: int) -> DataFrame:
    """city, cell, score: the best of the areas with enough people, or of all where fewer than three have enough."""
    city = W.partitionBy("city")
    own = members.withColumn("_some", F.sum((F.col("pop") >= least_people).cast("int")).over(city))
    own = own.where((F.col("pop") >= least_people) | (F.col("_some") < 3))
    first = F.row_number().over(city.orderBy(F.desc("score"), "cell"))
    return own.withColumn("_r", first).where("_r = 1").select("city", "cell", "score")
