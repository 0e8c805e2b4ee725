from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from placeframe.config import SCORING, Factor, Scoring
from placeframe.functions import scoring as S
from placeframe.operators import rank, score

ROAD = SCORING.factors[0]


@pytest.mark.parametrize(("km", "sub"), [(0, 100), (1, 95), (2, 90), (5, 70), (10, 40), (17.5, 20), (25, 0), (99, 0), (None, None), (float("nan"), None)])
def test_subscore_knots(spark, km, sub):
    row = spark.createDataFrame([(None if km is None else float(km),)], "v double").select(S.subscore(ROAD, F.col("v")).alias("s")).first()
    assert row.s == (None if sub is None else pytest.approx(sub))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Factor("x", "access", "km", ((1, 0), (1, 2)))
    with pytest.raises(ValueError):
        Scoring((ROAD,), {"a": {"nh_access": 0.5}}, "a")


CELLS = "cell long, city string, pop double, nh_access double, rail_access double, metro_access double, road_strength double, built_up_growth double"


def test_unobserved_factors_are_left_out_not_zero(spark):
    rows = [(1, "a", 10.0, 0.0, None, None, None, None), (2, "a", 30.0, None, None, None, None, None), (3, "a", 20.0, 25.0, 0.0, 0.0, 3.0, 15.0)]
    made = {r.cell: r for r in score.explained_areas(spark.createDataFrame(rows, CELLS), SCORING, "balanced").collect()}
    assert made[1].score == pytest.approx(100) and made[1].coverage == pytest.approx(0.25) and made[1].momentum is None
    assert made[2].score is None and made[2].drivers == []
    assert made[3].score == pytest.approx(75) and made[3].drivers[0] == "built_up_growth" and made[3].gaps == ["nh_access"]
    city = score.city_scores(score.scored_areas(spark.createDataFrame(rows, CELLS), SCORING, "balanced"), SCORING, "balanced").first()
    assert city.people == 30 and city.areas == 2
    assert sum(city[f"p_{f}"] or 0 for f in SCORING.names) == pytest.approx(city.score)


def test_lower_weighted_median_is_observed(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", None, 5)], "k string, v double, w long")
    assert [tuple(r) for r in score.lower_weighted_median(rows, ["k"], "v", "w").collect()] == [("a", 2.0)]


def test_ties_share_a_rank(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, 1.0)], "id long, s double").withColumn("g", F.lit(1))
    assert {r.id: r["rank"] for r in rank.competition_rank(rows, ["g"], "s").collect()} == {2: 1, 1: 2, 3: 2, 4: 4}


def test_search_prefers_prefix_then_own_name(spark):
    rows = spark.createDataFrame([(1, "New Goa", ["Goa"], 5), (2, "Goa", [], 1), (3, "Lagoan", [], 99), (4, "Pune", [], 9)], "id long, name string, aliases array<string>, people long")
    assert [(r.id, r.matched) for r in rank.search(rows, " GOA").orderBy("rank").collect()] == [(1, "Goa"), (2, "Goa"), (3, "Lagoan")]
    with pytest.raises(ValueError):
        rank.search(rows, "g")
