from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from placeframe.operators import contracts as C

CONTRACT = {
    "cities": C.Table(
        (C.Field("id", "bigint"), C.Field("name", "string", text=True), C.Field("pop", "bigint", least=1), C.Field("tier", "string", among=("metro", "mid")), C.Field("n", "bigint"), C.Field("share", "double", nullable=True, least=0.0, most=1.0), C.Field("w", "map<string,double>", keys=("a", "b"))),
        unique=(("id",),),
        derived={"tier": "CASE WHEN pop >= 100 THEN 'metro' ELSE 'mid' END"},
        rules={"weights": ("error", "abs(aggregate(map_values(w), 0D, (s, v) -> s + v) - 1) > 1e-6")},
        references=(C.Reference(("id",), "areas", ("city",)),),
        counts=(C.Count("n", "id", "areas", "city", "city IS NOT NULL"),),
        rows=(1, 3),
    ),
    "areas": C.Table((C.Field("city", "bigint"), C.Field("cell", "string")), unique=(("city", "cell"),), references=(C.Reference(("city",), "cities", ("id",), "warning"),)),
}


@pytest.fixture(scope="module")
def sound(spark):
    w = {"a": 0.25, "b": 0.75}
    cities = [(1, "Ash", 500, "metro", 2, 0.5, w), (2, "Elm", 20, "mid", 1, None, w)]
    areas = [(1, "x"), (1, "y"), (2, "x")]
    return {
        "cities": spark.createDataFrame(cities, "id long, name string, pop long, tier string, n long, share double, w map<string,double>"),
        "areas": spark.createDataFrame(areas, "city long, cell string"),
    }


def issues(spark, tables):
    return {(r.level, r.table, r.check, r["count"]) for r in C.check(spark, tables, CONTRACT).collect()}


def test_sound_tables_have_no_issue(spark, sound):
    assert issues(spark, sound) == set()


def at(column, value, key=2):
    return lambda t: {**t, "cities": t["cities"].withColumn(column, F.when(F.col("id") == key, F.expr(value)).otherwise(F.col(column)))}


E, W = "error", "warning"
SPOILED = {
    "no table": (lambda t: {"cities": t["cities"]}, {(E, "areas", "missing_table", 1)}),
    "no column": (lambda t: {**t, "cities": t["cities"].drop("pop")}, {(E, "cities", "missing:pop", 1)}),
    "more columns": (lambda t: {**t, "areas": t["areas"].withColumn("check", F.lit(1))}, {(E, "areas", "unknown:check", 1)}),
    "other type": (lambda t: {**t, "cities": t["cities"].withColumn("pop", F.col("pop").cast("string"))}, {(E, "cities", "type:pop", 1)}),
    "null": (at("name", "NULL"), {(E, "cities", "null:name", 1)}),
    "blank": (at("name", "' '"), {(E, "cities", "blank:name", 1)}),
    "below": (at("pop", "0"), {(E, "cities", "below:pop", 1)}),
    "above": (at("share", "1.25D"), {(E, "cities", "above:share", 1)}),
    "no number": (at("share", "double('NaN')"), {(E, "cities", "below:share", 1), (E, "cities", "above:share", 1)}),
    "unlisted": (at("tier", "'huge'"), {(E, "cities", "unlisted:tier", 1), (E, "cities", "derived:tier", 1)}),
    "derived": (at("tier", "'metro'"), {(E, "cities", "derived:tier", 1)}),
    "keys": (at("w", "map('a', 0.25D, 'c', 0.75D)"), {(E, "cities", "keys:w", 1)}),
    "rule": (at("w", "map('a', 0.5D, 'b', 0.75D)"), {(E, "cities", "weights", 1)}),
    "count": (at("n", "5"), {(E, "cities", "count:n", 1)}),
    "repeated": (lambda t: {**t, "cities": t["cities"].union(t["cities"].where("id = 2"))}, {(E, "cities", "repeated:id", 1)}),
    "too many": (lambda t: {**t, "cities": t["cities"].union(t["cities"])}, {(E, "cities", "repeated:id", 2), (E, "cities", "rows", 4)}),
    "none": (lambda t: {k: v.limit(0) for k, v in t.items()}, {(E, "cities", "rows", 1), (E, "areas", "rows", 1)}),
    "unresolved": (lambda t: {**t, "areas": t["areas"].union(t["areas"].select(F.lit(9), "cell"))}, {(W, "areas", "unresolved:city", 3), (E, "areas", "repeated:city,cell", 1)}),
    "nothing refers to it": (lambda t: {**t, "areas": t["areas"].where("city = 1")}, {(E, "cities", "unresolved:id", 1), (E, "cities", "count:n", 1)}),
    "null key": (lambda t: {**t, "areas": t["areas"].withColumn("city", F.when(F.col("cell") == "y", None).otherwise(F.col("city")))}, {(E, "areas", "null:city", 1), (E, "cities", "count:n", 1)}),
}


@pytest.mark.parametrize("name", SPOILED)
def test_each_rule_finds_its_rows(spark, sound, name):
    spoil, want = SPOILED[name]
    assert issues(spark, spoil(sound)) == want


def test_profile_of_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a long, b long")
    assert C.key_profile(df, "t", ("a", "b")).first()[:] == ("t", "a,b", 5, 2, 40.0, 1, 2)
    assert C.key_profile(df.limit(0), "t", ("a",)).first()[:] == ("t", "a", 0, 0, None, 0, 0)
