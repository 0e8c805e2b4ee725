from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from placeframe.sources.commits import Commits
from placeframe.sources import readers, writers


def test_feed_is_text_and_needs_its_columns(spark, tmp_path):
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    (sub / "stops.txt").write_text("﻿stop_id, stop_lat ,stop_lon,extra\n0012, 12.5,77.1,x\n")
    (sub / "routes.txt").write_text("route_id\nr\n")
    (sub / "trips.txt").write_text("route_id,trip_id\nr,t\n")
    (sub / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence\nt,0012,1\n")
    (sub / "shapes.txt").write_text("shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n")
    feed = readers.feed(spark, str(tmp_path))
    assert feed["stops"].columns == ["stop_id", "stop_lat", "stop_lon"]
    assert tuple(feed["stops"].first()) == ("0012", "12.5", "77.1")
    (sub / "trips.txt").write_text("route_id\nr\n")
    with pytest.raises(readers.FeedError):
        readers.feed(spark, str(tmp_path))


def test_broken_lines_are_dropped(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,y,z\n3,4\n")
    assert sorted(map(tuple, readers.tolerant_csv(spark, str(tmp_path / "x.csv"), "a int, b int").collect())) == [(1, 2), (3, 4)]
    assert readers.two_field_lines(spark, str(tmp_path / "x.csv"), ("p", "q")).count() == 3


def test_geojson_points(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"name": "A", "other": 1}, "geometry": {"type": "Point", "coordinates": [77.5, 12.25]}}
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    rows = readers.points(readers.geojson(spark, str(tmp_path / "x.json"), "name:string"))
    assert [tuple(r) for r in rows.collect()] == [("A", 77.5, 12.25)]


def test_placemarks(spark, tmp_path):
    (tmp_path / "x.kml").write_text(
        "<kml><Document><Placemark><name>S</name><Point><coordinates>72.8,19.1,0</coordinates></Point>"
        '<ExtendedData><Data name="line"><value>west</value></Data></ExtendedData></Placemark>'
        "<Placemark><name>L</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></Document></kml>"
    )
    made = {r.name: r for r in readers.placemarks(spark, str(tmp_path / "x.kml")).collect()}
    assert tuple(made["S"].point) == (72.8, 19.1) and made["S"].data == {"line": "west"}
    assert [tuple(p) for p in made["L"].line] == [(1.0, 2.0), (3.0, 4.0)]


def test_release_pages(spark):
    pages = spark.createDataFrame([(1, "<html><head><title> T  x</title></head><body><p>One <b>two</b></p><p> </p></body></html>"), (2, None)], "page_id long, html string")
    made = {r.page_id: tuple(r)[1:] for r in readers.releases(pages).collect()}
    assert made == {1: ("T x", ["One two"], None), 2: ("", [], "no body")}


def test_news_in_either_form(spark, tmp_path):
    items = [{"results": [{"link": "u1", "title": "a", "snippet": "s", "publishedAt": "d"}]}, {"url": "u2", "title": "b", "description": " "}]
    (tmp_path / "n.json").write_text(json.dumps(items))
    made = sorted(map(tuple, readers.news_items(spark, str(tmp_path / "n.json")).collect()))
    assert made == [("u1", "a", "s", "d"), ("u2", "b", None, None)]


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    df = spark.range(10).toDF("id")
    assert writers.published(spark, out) == {}
    assert writers.publish({"a": df, "b": df}, out) == 0
    with pytest.raises(writers.TooLarge):
        writers.publish({"a": df.limit(1), "b": df.limit(1)}, out, budget=1)
    bad = df.select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):  # between two tables
        writers.publish({"a": df.limit(1), "b": bad}, out)
    with monkeypatch.context() as m:

        def stops(*_):
            raise RuntimeError("stopped")

        m.setattr(writers.Commits, "add", stops)
        with pytest.raises(RuntimeError):
            writers.publish({"a": df.limit(1), "b": df.limit(1)}, out)
    seen = writers.published(spark, out)
    assert {k: t.count() for k, t in seen.items()} == {"a": 10, "b": 10} and len(list((tmp_path / "out/sets").iterdir())) == 1
    for n in (3, 4, 5):
        writers.publish({"a": df.limit(n), "c": df.limit(n)}, out)
    assert {k: t.count() for k, t in writers.published(spark, out).items()} == {"a": 5, "c": 5}
    assert len(list((tmp_path / "out/sets").iterdir())) == 2  # this one and the one before


def test_of_two_publishers_one_fails(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    assert commits.last() == (-1, {})
    commits.add(0, {"x": "é"})
    with pytest.raises(FileExistsError):
        commits.add(0, {"x": 2})
    assert commits.last() == (0, {"x": "é"})


def test_manifest_and_changes(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "y.bin").write_bytes(b"abc")
    m = readers.manifest(spark, str(tmp_path))
    assert {r.kind for r in m.collect()} == {"pdf", "other"}
    assert readers.changed(m, m).count() == 0 and readers.changed(m, m.limit(0)).count() == 2


def test_features(spark):
    rows = spark.createDataFrame([("a", [{"x": 1.00004, "y": 2.0}]), ("b", [])], "name string, at array<struct<x:double,y:double>>")
    made = [json.loads(r.value) for r in writers.features(rows, "Point", "at", "name").collect()]
    assert made == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "a"}}]
