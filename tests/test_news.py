from __future__ import annotations

import datetime

import pytest

from placeframe.operators import news

DESK = news.Desk((("opens for public", "excluded"), ("tender|bids", "tender"), ("approv", "approved")), {"metro": "metro", "bus": r"\bbus"}, ("wiki.example",), "^list of", 400, 0.5, 0.2, 0.1, 0.55)
ITEM = "item long, title string, url string, description string, date string, fetched_at date"
DAY = datetime.date(2025, 1, 1)
OK = "https://n.example/2024/10/05/x"


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([("pune", "Pune", ["Poona"]), ("agra", "Agra", None), ("delhi", "Delhi", [])], "city string, name string, aliases array<string>")


def found(spark, cities, *items):
    rows = [(i, *it, DAY) for i, it in enumerate(items)]
    return news.extracted(spark.createDataFrame(rows, ITEM), cities, DESK)


def test_every_item_left_out_has_its_first_reason(spark, cities):
    cases = {
        "no_title_or_link": [("", OK, "x", None), (None, OK, None, None), ("Metro tender Pune", "ftp://n", "", None), ("Metro tender Pune", None, "", None)],
        "not_news_source": [("Metro tender Pune", "https://en.wiki.example/a", "", None), ("Metro tender Pune", "https://WIKI.example/a", "", None)],
        "reference_page": [("List of metro tenders in Pune", OK, "", None)],
        "stale": [("Metro tender Pune", "https://n.example/2020/01/02/x", "", None), ("Metro tender Pune", OK, "", "2020-05-01")],
        "no_stage_rule": [("Metro in Pune", OK, None, None)],
        "not_upcoming": [("Metro opens for public in Pune after tender", OK, "", None)],
        "no_mode": [("Tender in Pune", OK, "", None)],
        "ambiguous_mode": [("Metro and bus tender in Pune", OK, "", None)],
        "no_configured_city": [("Metro tender in Punekar", OK, "", None)],
        "low_confidence": [("Metro tender in Pune", "https://n.example/x", "", None)],
    }
    items = [(reason, it) for reason, all_ in cases.items() for it in all_]
    made = found(spark, cities, *[it for _, it in items]).collect()
    assert {r.item: r.reason for r in made} == {i: reason for i, (reason, _) in enumerate(items)}
    assert len(made) == len(items) and all(r.id is None and r.stage is None for r in made)


def test_a_project_for_each_city_named(spark, cities):
    item = ("Metro  plan", OK, "Work goes on. Bids for Rs 1,200 crore invited in POONA and Agra. It cost Rs 5 crore before.", "2024-11-02T08:00:00")
    made = sorted(found(spark, cities, item).collect(), key=lambda r: r.city)
    assert [(r.city, r.mode, r.stage, r.name, r.reason) for r in made] == [(c, "metro", "tender", "Metro plan", None) for c in ("agra", "pune")]
    assert {r.evidence for r in made} == {"Bids for Rs 1,200 crore invited in POONA and Agra."}
    assert {(r.cost_crore, r.length_km, r.event_date, r.confidence) for r in made} == {(1200.0, None, datetime.date(2024, 11, 2), 0.8)}
    assert len({r.id for r in made}) == 2 and made[0].id.startswith("agra-metro-")


def test_the_most_confident_and_then_the_later_item_is_kept(spark, cities):
    stated, bare = ("Metro tender of Rs 10 crore in Agra", OK, "", None), ("Metro tender in Agra", OK, "", None)
    kept = news.projects(found(spark, cities, stated, bare)).collect()
    assert [(r.item, r.confidence) for r in kept] == [(0, 0.8)]
    assert [r.item for r in news.projects(found(spark, cities, bare, bare)).collect()] == [1]
    assert [(r.item, r.reason) for r in news.rejects(found(spark, cities, bare, ("Agra", OK, "", None))).collect()] == [(1, "no_stage_rule")]


def test_no_items(spark, cities):
    assert news.extracted(spark.createDataFrame([], ITEM), cities, DESK).count() == 0
