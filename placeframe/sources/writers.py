"""Writers of published tables: staged, sorted and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.sources.commits import Commits


class TooLarge(ValueError):
    """What was to be published is larger than its budget."""


def publish(tables: dict[str, DataFrame], folder: str, budget: int | None = None) -> int:
    """Publishes all tables, or none, and gives the number of the set; published() reads one.

    A set is a folder of its own that nobody reads while it is written. Its size is checked, and one commit record, the last
    step, makes it the set that is read. Whatever stops before that leaves the set before as it was. The set before stays for
    readers that began with it; older sets and unfinished ones go. One publisher at a time: of two the second one fails.
    """
    spark = next(iter(tables.values())).sparkSession
    commits = Commits(spark, folder)
    number, before = commits.last()
    name = f"sets/{number + 1}-{uuid.uuid4().hex}"
    try:
        for table, df in tables.items():
            df.write.parquet(f"{commits.folder}/{name}/{table}")
        size = commits.size(name)
        if budget is not None and size > budget:
            raise TooLarge(f"{size} bytes are more than {budget}")
        commits.add(number + 1, {"set": name, "tables": sorted(tables), "bytes": size})
    except BaseException:
        commits.delete(name)
        raise
    for old in commits.folders("sets"):
        if f"sets/{old}" not in (name, before.get("set")):
            commits.delete(f"sets/{old}")
    commits.forget(number)
    return number + 1


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the set published last, all of one set; none before the first."""
    commits = Commits(spark, folder)
    _, record = commits.last()
    return {t: spark.read.parquet(f"{commits.folder}/{record['set']}/{t}") for t in record.get("tables", [])}


def features(rows: DataFrame, kind: str, coordinates: str, *properties: str) -> DataFrame:
    """value: a GeoJSON feature for each row whose coordinates are not empty, on a grid of four decimals."""
    grid = F.transform(coordinates, lambda p: F.array(F.round(p["x"], 4), F.round(p["y"], 4)))
    shape = F.get(grid, 0) if kind == "Point" else grid
    geometry = F.struct(F.lit(kind).alias("type"), shape.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.where(F.size(coordinates) > 0).select(F.to_json(feature).alias("value"))


def city_documents(rows: DataFrame, folder: str) -> None:
    """One folder of gzip JSON lines for each city, its rows together."""
    rows.repartition("city").write.mode("overwrite").partitionBy("city").json(folder, compression="gzip")


def report(rows: DataFrame, folder: str, *order: str) -> None:
    """CSV in a total order, nulls as blanks, so that a second run writes the same bytes."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").csv(folder)


def percent(share: F.Column) -> F.Column:
    return F.when(share.isNotNull(), F.concat(F.format_number(share * 100, 1), F.lit("%"))).otherwise("")
