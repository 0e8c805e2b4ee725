"""Jobs without SQL, each against a plain version on a small fixture."""

from __future__ import annotations

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from placeframe.functions import geo, text
from placeframe.operators import areas, events, graph, names


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("Work on NH-275 and National Highway 48 began; NH 66 A follows, NH-275 again", ["NH275", "NH48", "NH66A"]),
        ("NH007BC by National Highway (NH)-7", ["NH7BC", "NH7"]),
        ("SH 12, NHX 4, 44", []),
        (None, None),
    ],
)
def test_road_numbers(spark, said, found):
    assert one(spark, events.road_numbers, said) == found


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("A bypass in Goa, Jammu and Kashmir and Ladakh was opened", ["Goa", "Jammu and Kashmir"]),
        ("The Delhi–Goa corridor in the State of Kerala", ["Kerala"]),
        ("Kerala has roads across Odisha and Bihar.", ["Odisha"]),
        ("Built in Goalpara", []),
    ],
)
def test_states_named(spark, said, found):
    got = one(spark, events.states_named, said)
    assert got[: len(found)] == found and "Delhi" not in got and (found or not got)


def test_modes_named(spark):
    assert one(spark, events.modes_named, "on Hybrid-Annuity, later EPC; a hamlet") == ["HAM", "EPC"]


def test_releases_get_one_class_each(spark):
    day = dt.date(2024, 5, 1)
    listed = spark.createDataFrame(
        [(None, "no page", day), (1, "Gone", day), (2, "Bad", day), (3, "दिल्ली", day), (4, "Weather", day), (5, "Road opened", day), (6, "Road opened", day), (7, "Road opened", day)],
        "page_id long, title string, published date",
    )
    pages = spark.createDataFrame(
        [
            (2, None, None, None, "no body"),
            (3, "दिल्ली में सड़क", ["सड़क"], day, None),
            (4, "Weather today", ["It rained."], day, None),
            (5, "Road opened in time", ["The road NH 44 was opened. It is long."], day, None),
            (6, "Road opened later", ["A road was opened."], day + dt.timedelta(days=3), None),
            (7, "Road opened at last", ["Nothing was said."], day, None),
        ],
        "page_id long, title string, paragraphs array<string>, posted date, error string",
    )
    rules = [events.Rule("^Road", "opened", "opening", "operational")]
    rows = {r["page_id"]: r for r in events.classified(listed, pages, rules).collect()}
    assert {k: r["class"] for k, r in rows.items()} == {
        None: "no_release_text", 1: "not_fetched", 2: "unparsed", 3: "unsupported_language", 4: "no_project_event", 5: "event", 6: "review", 7: "review",
    }
    assert rows[5]["refs"] == ["NH44"] and rows[5]["reasons"] == []
    assert rows[6]["reasons"] == ["no_anchor", "listing_date_mismatch"]
    assert rows[7]["reasons"] == ["no_evidence_sentence"]
    assert events.classified(listed.limit(0), pages, rules).collect() == []


def plain_score(a, b):
    x, y = set(a.split()), set(b.split())
    short, other = (x, y) if len(x) <= len(y) else (y, x)
    if short and short <= other and max(map(len, short)) >= 4:
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def keys_alike(rng, n):
    """Keys of one to thirty letters, many of them copies of others with letters changed, swapped, doubled or cut, or with words more."""
    out = ["", "a", "ab", "abc", "abd", "aabb", "karnal", "kharnal toll", "x" * 9, "x" * 10]
    while len(out) < n:
        k = rng.choice(out) if rng.random() < 0.7 else "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 30)))
        i = rng.randrange(len(k) + 1)
        k = rng.choice([k[:i] + rng.choice("abcdef") + k[i:], k[:i] + k[i + 1 :], k[:i] + k[i + 1 : i + 2] + k[i : i + 1] + k[i + 2 :], k + " " + rng.choice(["sonipat", "east", "b"]), k[i:] + k[:i], k])
        out.append(" ".join(k.split()))
    return out


@pytest.mark.parametrize("least", [0.801, 0.82, 0.9, 1.0])
def test_no_candidate_is_lost(spark, least):
    rng = random.Random(17)
    keys = [(k, rng.choice("xy")) for k in keys_alike(rng, 170)] + [(None, "x"), ("karnal", None)]
    codes = [(k, rng.choice("xy")) for k in keys_alike(rng, 170)]
    made = names.candidates(spark.createDataFrame(keys, "key string, state string"), spark.createDataFrame(codes, "key string, state string"), least)
    scored = made.select("*", text.name_similarity(F.col("key"), F.col("ckey")).alias("score")).collect()
    assert all(r.score == plain_score(r.key, r.ckey) for r in scored)
    want = {(s, a, b) for a, s in keys for b, t in codes if a and b and s == t and plain_score(a, b) >= least}
    assert want == {(r.state, r.key, r.ckey) for r in scored if r.score >= least}
    assert len(scored) == len({(r.state, r.key, r.ckey) for r in scored})


def test_matching_is_the_walk_in_order(spark):
    rng = random.Random(5)
    words = ["ambala", "amballa", "amballa toll", "karnal", "karnall", "kharnal", "sonipat", "sonipath", ""]
    rows = [(i, rng.randrange(50), rng.choice(words), rng.choice("xy")) for i in range(40)]
    codes = [(i if i % 9 else None, rng.choice(words), rng.choice("xy")) for i in range(40)]
    r = spark.createDataFrame(rows, "id long, place long, key string, state string")
    c = spark.createDataFrame(codes, "code long, key string, state string")
    taken, want = set(), {}
    for i, _, key, state in sorted(rows, key=lambda t: (t[1], t[0])):
        free = [(plain_score(key, k), code) for code, k, s in codes if key and s == state and code is not None and code not in taken]
        if free and max(free)[0] >= 0.82:
            want[i] = max(free)[1]
            taken.add(want[i])
    got = {x["id"]: x["code"] for x in names.matched(r, c, 0.82).collect()}
    assert got == want and got
    assert names.matched(r.limit(0), c, 0.82).collect() == []


def test_words_of_a_text_are_split_once(spark):
    said = F.concat(F.lit("by NH-7 in Goa on EPC "), F.col("id").cast("string"))
    plans = [spark.range(1).select(f(said).alias("v"))._jdf.queryExecution().analyzed().toString() for f in (events.road_numbers, events.states_named, events.modes_named)]
    assert [p.count("split(") for p in plans] == [1, 2, 1]  # of states by 'in' and by commas


def test_rows_of_one_name_share_a_list_of_codes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(names, "table", lambda df, name, keep=names.table: made.append(name) or keep(df, name))
    r = spark.createDataFrame([(i, i * 7 % 131, ("hot ring", "hot rings")[i % 3 == 0], "s") for i in range(90)], "id long, place long, key string, state string")
    c = spark.createDataFrame([(1000 + i, ("hot ring", "hot rings")[i % 2], "s") for i in range(70)], "code long, key string, state string")
    got = {x["id"]: x["code"] for x in names.matched(r, c, 0.82).collect()}
    want, left = {}, [(x["code"], x["key"]) for x in c.collect()]
    for x in sorted(r.collect(), key=lambda x: (x["place"], x["id"])):
        if left:
            taken = max(left, key=lambda y: (y[1] == x["key"], y[0]))
            left.remove(taken)
            want[x["id"]] = taken[0]
    assert got == want and len(got) == 70
    assert len(made) < 60  # by pairs there was a round for nearly each row


def test_circuity_of_a_square(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 3.0), (3, 3.0, 3.0), (4, 3.0, 0.0), (8, 9.0, 9.0), (9, 9.0, 8.0)], "node_id long, x double, y double")
    links = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (3, 4, 3.0), (8, 9, 1.0)], "a long, b long, length double")
    cities = spark.createDataFrame([(10, 0.0, -0.5), (11, 3.0, -0.5), (12, 3.0, 3.5), (13, 9.0, 9.0), (14, 0.0, -0.6)], "id long, x double, y double")
    rows = {(r["a"], r["b"]): r for r in graph.circuity(links, nodes, cities, 1.0, (0.5, 5.0), 1.0).collect()}
    assert set(rows) == {(10, 11), (10, 12), (11, 12), (11, 14)}  # 12 and 14 are 5.08 apart
    assert rows[10, 11]["network"] == pytest.approx(10.0) and rows[10, 11]["flagged"]
    assert rows[11, 12]["circuity"] == pytest.approx(1.0) and not rows[11, 12]["flagged"]


def test_projection_keeps_lengths_on_its_parallels(spark):
    d = 1e-3
    df = spark.createDataFrame([(75.0, geo.CONIC[0])], "lon double, lat double")
    east, north = geo.conic(F.col("lon"), F.col("lat"))
    e2, n2 = geo.conic(F.col("lon") + d, F.col("lat"))
    metres = F.sqrt(F.pow(e2 - east, 2) + F.pow(n2 - north, 2))
    km = geo.ellipsoid_km(F.col("lon"), F.col("lat"), F.col("lon") + d, F.col("lat"))
    r = df.select(metres.alias("m"), km.alias("km")).first()
    assert r["m"] == pytest.approx(r["km"] * 1000, rel=1e-4)
    centre = spark.createDataFrame([(80.0, 24.0)], "lon double, lat double").select(*[c.alias(n) for c, n in zip(geo.conic(F.col("lon"), F.col("lat")), "en")]).first()
    assert centre["e"] == pytest.approx(4e6) and centre["n"] == pytest.approx(4e6)


def test_scanned_rows(spark):
    row = lambda v: one(spark, text.annexure_row, v)
    assert tuple(row("12 Hill & Vale 1,2l3 4] O I| 7")) == ("Hill & Vale", [1213, 41, 0, 11])
    assert tuple(row("Total l0 20")) == ("Total", [10, 20])
    assert row("12 Hill 1 2 x 4 7") is None and row("") is None and row(None) is None


def test_stations_once_for_each_place(spark):
    mapped = spark.createDataFrame([(1, "rail", "a", 0.0, 0.0), (2, "rail", "b", 0.1, 0.0), (3, "metro", "b", 0.1, 0.0)], "id long, mode string, key string, x double, y double")
    listed = spark.createDataFrame([(1, "rail", "a", 0.9, 0.0), (2, "rail", "c", 0.8, 0.0), (3, "metro", "d", 0.15, 0.0), (4, "rail", "z", 5.0, 5.0)], mapped.schema)
    got = {(r["source"], r["id"]) for r in areas.stations(listed, mapped, 1.0, 0.2).collect()}
    assert got == {("mapped", 1), ("mapped", 3), ("listed", 2), ("listed", 4)}


def test_road_job_lists_every_fault(spark):
    from placeframe.operators import roads

    ways = spark.createDataFrame(
        [(1, {"highway": "trunk", "ref": "NH 44"}), (2, {"highway": "trunk", "ref": "??"}), (3, {"highway": "motorway"}), (4, {"highway": "trunk"}), (5, {"highway": "path"})],
        "way_id long, tags map<string,string>",
    )
    nodes = spark.createDataFrame([(w, p, 10 * w + p, x + p * 0.1, 0.5) for w, x in ((1, 0.2), (2, 0.4), (4, 50.0), (5, 0.1)) for p in (1, 2)] + [(3, 1, 31, 0.0, 0.0)], "way_id long, pos int, node_id long, lon double, lat double")
    relations = spark.createDataFrame([(9, "NH7", 2), (8, None, 2)], "relation_id long, ref string, way_id long")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    states = spark.createDataFrame([("S", ring)], "name string, ring array<struct<x:double,y:double>>")
    made = roads.road_job(ways, relations, nodes, states, (0.0, 0.0, 10.0, 10.0), 0.01, 0.5, 1.0)
    rows = {r["way_id"]: r for r in made["roads"].collect()}
    assert set(rows) == {1, 2, 4} and rows[1]["state"] == "S" and rows[1]["km"] == pytest.approx(11.13, abs=0.02)
    assert (rows[1]["ref"], rows[2]["ref"], rows[2]["source"]) == ("NH44", "NH7", "relation")
    assert {(r["way_id"], r["reason"]) for r in made["errors"].collect()} == {(2, "unparsed_ref"), (3, "incomplete_geometry"), (4, "outside_box"), (4, "no_state")}
