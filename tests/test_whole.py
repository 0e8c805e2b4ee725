"""Queries that read whole tables, against their SQL in DuckDB and by hand."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import pytest

from placeframe.operators import rank
from placeframe.operators.mentions import mentions
from placeframe.plans import catalog
from test_oracle import TABLES, plain

CHECKED = ["w6_junction_edges", "j14_name_mentions", "g1_g3_nearest_distances"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_meets_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]}) t").fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in theirs)
    assert theirs


def test_a_node_of_two_ways_cuts_both(spark, tmp_path):
    rows = [(w, i, n, 0, 1.0, 1.0, "") for w, nodes in {1: [1, 2, 3, 4], 2: [5, 3, 6, 7]}.items() for i, n in enumerate(nodes)]
    line = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string"
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {(r.way_id, r.u, r.v) for r in catalog.QUERIES["w6_junction_edges"](spark, str(tmp_path)).collect()}
    assert made == {(1, 1, 3), (1, 3, 4), (2, 5, 3), (2, 3, 7)}


def test_mentions_are_those_of_the_reference(spark):
    texts = ["Metro for NEW DELHI, phase 2", "delhi only", "newdelhi", "In St. Louis (USA)", "Bombay and Navi Mumbai", "C++ a--b", "New York, Delhi", None, "", "K\\E x"]
    names = [("New Delhi", ["Dilli", "NCT of Delhi"]), ("Mumbai", ["Bombay"]), ("St. Louis", None), ("Navi Mumbai", []), ("--", []), ("York", ["new york"]), ("K\\E x", []), (".*", [])]
    want = {(i, n) for i, t in enumerate(texts) for n, more in names if t and any(re.search(rf"\b{re.escape(x)}\b", t, re.IGNORECASE) for x in [n, *(more or [])])}
    made = mentions(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(names, "name string, aliases array<string>"))
    assert {(r.id, r.name) for r in made.collect()} == want
    assert made.count() == len(want)


def test_rounding_and_distances_leave_no_customer_out(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    want = {r.c_custkey: Decimal(repr(r.c_acctbal / 7)).quantize(Decimal("0.1"), ROUND_HALF_EVEN) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r.c_custkey: Decimal(repr(r.shown)) for r in catalog.QUERIES["p24_published_all"](spark, sf).collect()} == want
    assert catalog.QUERIES["g1_g3_nearest_distances"](spark, sf).count() == n


def test_search_numbers_rows_by_ranges(spark):
    rows = [(i, "river", [], i * 37 % 1009) for i in range(3000)]
    made = rank.search(spark.createDataFrame(rows, "id long, name string, aliases array<string>, people long").repartition(5), "riv")
    assert "row_number() windowspecdefinition(prefix" not in made._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert {r.id: r["rank"] for r in made.collect()} == {r[0]: i for i, r in enumerate(order, 1)}


def test_equal_texts_are_asked_once(spark, monkeypatch):
    from placeframe.operators import mentions as m

    made = {}
    monkeypatch.setattr(m, "table", lambda df, name, keep=m.table: made.setdefault(name, keep(df, name)))
    texts = spark.createDataFrame([(i, ("Old Mill road", "new mill", None)[i % 3]) for i in range(30)], "id long, text string")
    said = spark.createDataFrame([("M", "mill"), ("R", "road")], "key string, said string")
    got = sorted(tuple(r) for r in m.said_in(texts, said).collect())
    assert got == sorted([(i, "M") for i in range(30) if i % 3 < 2] + [(i, "R") for i in range(0, 30, 3)])
    assert made["texts"].count() == 2 and made["said"].count() == 3
