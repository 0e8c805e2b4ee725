"""Registered queries against their SQL in DuckDB on small tables with odd values."""

from __future__ import annotations

import duckdb

from placeframe.plans import catalog


def rows_of(spark, folder, name, **tables):
    """The query's rows and its SQL's, both sorted, on tables given as SQL of DuckDB."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    ours = sorted(map(tuple, df.select(*columns).collect()), key=str)
    return ours, sorted(con.sql(f"SELECT {names} FROM ({catalog.SQL[name]}) t").fetchall(), key=str)


def test_confidence_is_rounded_as_stored(spark, tmp_path):
    sql = "SELECT i::BIGINT AS c_custkey, 1::BIGINT AS c_nationkey, 'BUILDING' AS c_mktsegment, v::DOUBLE AS c_acctbal FROM (VALUES (1, 5005.0), (2, 5000.0), (3, 1005.0), (4, 5015.0), (5, -5005.0), (6, -0.3), (7, NULL)) t(i, v)"
    ours, theirs = rows_of(spark, tmp_path, "q7_projects_of_a_city", customer=sql)
    assert ours == theirs and len(ours) == 7


def test_a_group_without_cells_has_no_ring(spark, tmp_path):
    customer = "SELECT i::BIGINT AS c_custkey FROM range(1, 12) t(i)"
    supplier = "SELECT i::BIGINT AS s_suppkey, (i % 2)::BIGINT AS s_nationkey FROM range(1, 4000) t(i)"
    ours, theirs = rows_of(spark, tmp_path, "a13_ring_effect", customer=customer, supplier=supplier)
    assert ours == theirs and len(ours) == 1


def test_quantiles_are_exact_and_held_by_no_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from placeframe.operators.rank import quantiles

    rows = spark.range(1000).select(F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101) / 8.0).alias("v"))
    want = rows.agg(F.percentile("v", 0.9), F.median("v"), F.percentile("v", 1.0)).first()
    assert tuple(quantiles(rows, "v", {"a": 0.9, "b": 0.5, "c": 1.0}).first()) == tuple(want)
    assert tuple(quantiles(rows.where("v IS NULL"), "v", {"a": 0.9}).first()) == (None,)
    sql = "SELECT v::DOUBLE AS l_extendedprice FROM (VALUES (5.0), (5.0), (NULL), (1.25), (1000.5)) t(v)"
    ours, theirs = rows_of(spark, tmp_path, "a36_gap_summary", lineitem=sql)
    assert ours == theirs
    plan = catalog.QUERIES["a36_gap_summary"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_streets_of_ways_in_any_order(spark, tmp_path):
    """Dead ends at the place of others, of their neighbour, and alone."""
    sql = "SELECT (i // 3 * (CASE WHEN i % 7 = 0 THEN 3360000 ELSE 1 END))::BIGINT AS l_orderkey, 1::BIGINT AS l_linenumber, i::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, DATE '1995-01-01' AS l_shipdate FROM range(1, 300) t(i)"
    for name in ("r5_street_gaps", "r3_street_components"):
        ours, theirs = rows_of(spark, tmp_path, name, lineitem=sql)
        assert ours == theirs and ours


def test_places_with_many_ids_meet_once(spark, monkeypatch):
    import random

    from placeframe.operators import spatial

    r = random.Random(3)
    rows = [(i, r.randrange(12) / 4, r.randrange(12) / 4) for i in range(240)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    placed = rows[:240]
    dist = {(a, b): ((x - u) ** 2 + (y - v) ** 2) ** 0.5 for a, x, y in placed for b, u, v in placed}
    monkeypatch.setattr(spatial, "ALIKE", 2)
    for dense in (20_000, 5):
        monkeypatch.setattr(spatial, "DENSE", dense)
        made = sorted((p.id, p.other) for p in spatial.within(df, df.where("id % 3 = 0"), 0.75).collect())
        assert made == sorted(k for k, d in dist.items() if d <= 0.75 and k[1] % 3 == 0)
        made = sorted((p.a, p.b) for p in spatial.pairs(df, 2.0, 1.0).collect())
        assert made == sorted(k for k, d in dist.items() if k[0] < k[1] and 1.0 <= d <= 2.0)
        made = sorted((p.a, p.b) for p in spatial.pairs(df, 0.5).collect())
        assert made == sorted(k for k, d in dist.items() if k[0] < k[1] and d <= 0.5)
    plan = spatial.within(df, df, 1.0, digits=6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_o") < plan.index("round(")  # once for two places, below the rows' making
