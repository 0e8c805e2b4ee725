"""Readers of the formats that place data come in. All return DataFrames; nothing is inferred from values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of a transit feed with the columns they must have and those that are kept.
FEED_NEEDS = {
    "stops": ("stop_id", "stop_lat", "stop_lon"),
    "routes": ("route_id",),
    "trips": ("route_id", "trip_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence"),
}
FEED_MORE = {"shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence")}
FEED_KEEPS = {
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("route_id", "trip_id", "shape_id", "direction_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
}
# Columns of a gazetteer dump.
GAZETTEER = (
    "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, "
    "feature_code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, "
    "population long, elevation int, dem int, timezone string, modified string"
)


class FeedError(ValueError):
    """A feed lacks a table or a column that it must have."""


def feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an unpacked transit feed, at any depth below the folder: every column is text, trimmed."""
    out = {}
    for name, needs in (FEED_NEEDS | FEED_MORE).items():
        options = {"header": True, "inferSchema": False, "recursiveFileLookup": True, "pathGlobFilter": f"{name}.txt"}
        raw = spark.read.options(**options).csv(folder) if name in FEED_NEEDS else _if_any(spark, folder, options)
        if raw is None:
            continue
        raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
        missing = [c for c in needs if c not in raw.columns]
        if missing:
            raise FeedError(f"{name} lacks {missing}")
        out[name] = raw.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in FEED_KEEPS[name] if c in raw.columns])
    return out


def _if_any(spark: SparkSession, folder: str, options: dict) -> DataFrame | None:
    raw = spark.read.options(**options).csv(folder)
    return raw if raw.columns else None


def tolerant_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of the schema's width; others are dropped."""
    return spark.read.schema(schema).options(header=header, mode="DROPMALFORMED").csv(path)


def two_field_lines(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where(F.size("p") == 2)
    return parts.select(*[F.trim(F.get("p", i)).alias(n) for i, n in enumerate(names)])


def gazetteer(spark: SparkSession, path: str, country: str, least_people: int) -> DataFrame:
    """Places of a country from a tab-separated dump without a header."""
    rows = spark.read.schema(GAZETTEER).options(sep="\t", quote="").csv(path)
    return rows.where((F.col("country") == country) & (F.col("population") >= least_people))


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature: the properties named by the schema, kind, and the coordinates as JSON text."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def points(features: DataFrame) -> DataFrame:
    """Point features with lon and lat in place of the coordinates."""
    pair = F.from_json("coordinates", "array<double>")
    own = features.where("kind = 'Point'")
    return own.withColumns({"lon": F.get(pair, 0), "lat": F.get(pair, 1)}).drop("kind", "coordinates")


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """name, point (lon, lat) or line (array of lon, lat), and data: a map of the extended data, from a KML file."""
    schema = (
        "name string, Point struct<coordinates:string>, LineString struct<coordinates:string>, "
        "ExtendedData struct<Data:array<struct<_name:string,value:string>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def lonlat(text: F.Column) -> F.Column:
        part = F.split(F.trim(text), ",")
        return F.struct(F.get(part, 0).try_cast("double").alias("lon"), F.get(part, 1).try_cast("double").alias("lat"))

    line = F.transform(F.filter(F.split(F.trim("LineString.coordinates"), r"\s+"), lambda t: t != ""), lonlat)
    data = F.map_from_entries(F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"], d["value"])))
    point = F.when(F.col("Point").isNotNull(), lonlat(F.col("Point.coordinates")))
    return rows.select("name", point.alias("point"), line.alias("line"), data.alias("data"))


class _Release(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.parts, self.inside, self.body = "", [], [], False

    def handle_starttag(self, tag, attrs):
        self.body |= tag == "body"
        if tag in ("title", "p"):
            self.inside.append(tag)
            if tag == "p":
                self.parts.append("")

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "p" in self.inside:
            self.parts[-1] += data
        elif "title" in self.inside:
            self.title += data


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page, html in zip(batch["page_id"], batch["html"], strict=True):
            parser = _Release()
            parser.feed(html or "")
            text = [" ".join(p.split()) for p in parser.parts]
            rows.append((page, " ".join(parser.title.split()), [t for t in text if t], None if parser.body else "no body"))
        yield pd.DataFrame(rows, columns=["page_id", "title", "paragraphs", "error"])


def releases(pages: DataFrame) -> DataFrame:
    """page_id, title, paragraphs, error from pages(page_id, html); a page without a body is a row with an error."""
    return pages.select("page_id", "html").mapInPandas(_parsed, "page_id long, title string, paragraphs array<string>, error string")


def news_items(spark: SparkSession, path: str) -> DataFrame:
    """url, title, description, date of items that are flat or hold a list of results, under either set of names."""
    item = "url string, link string, title string, description string, snippet string, date string, publishedAt string"
    rows = spark.read.schema(f"{item}, results array<struct<{item.replace(' string', ':string')}>>").option("multiLine", True).json(path)
    names = [x.split()[0] for x in item.split(", ")]
    itself = F.array(F.struct(*names))
    each = rows.select(F.explode(F.when(F.size("results") > 0, F.col("results")).otherwise(itself)).alias("i"))
    said = lambda *c: reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.trim(f"i.{x}"), F.lit("")) for x in c])
    return each.select(said("url", "link").alias("url"), said("title").alias("title"), said("description", "snippet").alias("description"), said("date", "publishedAt").alias("date"))


def pixels(table: DataFrame, origin: tuple[float, float], step: tuple[float, float], window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Populated pixels (row, col, value) with lon and lat of their centres; a window (least lon, least lat, most lon, most
    lat) becomes a range of rows and columns, which the scan can skip by."""
    lon, lat = (F.lit(origin[i]) + (F.col(c) + 0.5) * F.lit(step[i]) for i, c in enumerate(("col", "row")))
    own = table.where("value > 0")
    if window:
        for c, i in (("col", 0), ("row", 1)):
            a, b = sorted((window[j] - origin[i]) / step[i] for j in (i, i + 2))
            own = own.where(F.col(c).between(int(a // 1), int(b // 1)))
    return own.withColumns({"lon": lon, "lat": lat})


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, kind and sha256 of every file; kind is told from its first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head.startswith("504B"), "zip").when(head == "25504446", "pdf").when(head == "50415231", "parquet").when(head.startswith("1F8B"), "gzip")
    return files.select("path", F.col("length").alias("bytes"), kind.otherwise("other").alias("kind"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """The files of a manifest that an earlier one does not list with the same content."""
    return now.join(before.select("path", "sha256"), ["path", "sha256"], "left_anti")
