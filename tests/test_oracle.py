"""Registered queries of the library against their SQL in DuckDB, by sorted rows. A sample of each module; the driver runs all."""

from __future__ import annotations

import math

import duckdb
import pytest

from placeframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "c2_area_scores", "c4_factor_summary", "w7_drivers_and_gaps", "q1_cities_of_a_state", "q2_search", "q6_compare_reasons",
    "j4_nearest_target", "j6_within_distance", "j7_point_in_polygon", "g14_hexagon_cells", "r1_a4_contiguous_cells", "g1_g3_distances", "w6_junction_split", "j14_mentions", "p24_published_rounding",
    "c5_weight_sensitivity", "j18_area_names", "c8_city_documents", "j8_nearest_polygon", "c15_feed_job", "p25_explanations", "g4_conic_projection", "s3_tolerant_rows",
    "a6_pivot", "a8_lower_weighted_median", "c12_project_flags", "a15_delay_table", "v1_feed_issues", "w18_route_lines", "p1_state_names", "st4_daily_counts",
    "p5_way_class", "g7_line_samples", "g10_clipped_lines", "g12_carriageways", "j15_corridors", "p10_p11_name_similarity", "w20_sorted_table", "c18_station_indicators",
    "p17_header_rows", "c6_urban_centres", "c9_city_layers", "r2_fill_from_neighbours",
    "g4_conic_round_trip", "g5_equal_area_km2", "a3_a11_density_km2", "g13_overlaps", "a13_ring_effect", "a14_rates_per_100km", "v5_contract", "v2_unique_keys", "v4_geography_contract", "v6_export_contract", "r3_street_components", "r5_street_gaps", "r6_street_paths",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_meets_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({catalog.SQL[name]}) t").fetchall())
    assert ours == theirs
    assert ours


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
