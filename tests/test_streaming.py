from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from placeframe.plans import streams
from placeframe.streaming import jobs
from placeframe.streaming.keyed import KeyedTable


def streamed(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_windows_on_a_stream_are_those_of_the_table(spark, tmp_path, sf):
    run(jobs.windowed_counts(streamed(spark, tmp_path, sf), "event_type", "1 day"), "complete", "windows")
    table = jobs.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "1 day")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, table.collect()))


SCHEMA = "k long, v long, name string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keyed_table_keeps_the_best_and_takes_each_batch_once(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    kept = KeyedTable(spark, str(tmp_path / "t"), frame((1, 1, "")).schema, ["k"], ("v", "name"), buckets=4)
    assert kept.read().count() == 0
    kept.merge(frame((1, 5, "a"), (2, 5, "b"), (None, 1, "n"), (1, 5, "c"), (3, None, "x")), 0)
    kept.merge(frame((1, 9, "d"), (2, 4, "e"), (None, 2, "m"), (3, None, "y")), 1)
    want = sorted([(1, 9, "d"), (2, 5, "b"), (None, 2, "m"), (3, None, "y")], key=str)
    assert rows_of(kept.read()) == want
    kept.merge(frame((1, 99, "again")), 1)  # a batch that has its record is skipped, whatever it holds
    kept.merge(frame((1, 99, "older")), 0)
    assert rows_of(kept.read()) == want
    kept.merge(frame((1, 99, "")).limit(0), 2)
    assert rows_of(kept.read()) == want and kept.commits.numbers() == [1, 2]


def test_a_batch_that_stops_before_its_record_changes_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7, f"n{i}") for i in range(200)], SCHEMA)
    kept = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], ("v", "name"))
    kept.merge(rows, 0)
    later = rows.where("k < 50").withColumn("v", F.col("v") + 10)

    def stops(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(kept.commits, "add", stops)
        with pytest.raises(RuntimeError):
            kept.merge(later, 1)
    assert rows_of(kept.read()) == rows_of(rows)
    kept.merge(later, 1)
    assert rows_of(kept.read()) == rows_of(later.unionByName(rows.where("k >= 50")))
    assert len(kept.commits.folders("data")) == 2  # what the stopped batch wrote is gone


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, "") for i in range(400)], SCHEMA)
    kept = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], ("v",), buckets=16)
    kept.merge(rows, 0)
    kept.merge(spark.createDataFrame([(7, 900, "")], SCHEMA), 1)
    folders = set(kept.commits.read(1)["held"].values())
    new = next(f for f in folders if f.startswith("data/1-"))
    assert len(list((tmp_path / "t" / new).glob("_bucket=*"))) == 1
    assert rows_of(kept.read()) == rows_of(rows.where("k <> 7").unionByName(spark.createDataFrame([(7, 900, "")], SCHEMA)))


def test_intake_takes_unseen_keys_only(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "first"), (2, 1, "first")], SCHEMA)
    taken = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"])
    taken.merge(rows, 0)
    taken.merge(spark.createDataFrame([(2, 9, "second"), (3, 9, "second")], SCHEMA), 1)
    assert rows_of(taken.read()) == [(1, 1, "first"), (2, 1, "first"), (3, 9, "second")]


def test_a_stream_that_is_begun_again_goes_on(spark, tmp_path, sf):
    """The same checkpoint and table, with files that arrive between two runs."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    kept = KeyedTable(spark, str(tmp_path / "t"), events.schema, ["user_id"], ("value", "event_id"))
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
        stream = jobs.arrivals([part.repartition(2)], str(tmp_path / "in"))
        jobs.finished(kept.sink(stream, str(tmp_path / "cp")))
    best = {}
    for r in events.collect():
        if r.user_id not in best or (r.value, r.event_id) > best[r.user_id]:
            best[r.user_id] = (r.value, r.event_id)
    assert {(r.user_id, (r.value, r.event_id)) for r in kept.read().collect()} == set(best.items())
    assert kept.commits.last()[0] == 3


@pytest.mark.parametrize("name", list(streams.QUERIES))
def test_stream_queries_meet_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "events", "nation", "customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    made = streams.QUERIES[name](spark, sf)
    columns = sorted(made.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({streams.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, made.select(*columns).collect()))) == sorted(map(str, want)) and want


def test_unseen_rows_come_once(spark, tmp_path, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").limit(20)
    rows.union(rows).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(jobs.unseen(stream, "event_id"), "append", "unseen")
    assert spark.table("unseen").count() == 20


def test_budget_opens_with_the_first_event(spark):
    rows = [(1, e, f"2024-01-01 00:00:{s:02d}") for e, s in enumerate((0, 5, 9, 11, 30))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    made = {r.event_id: (r.over, r.retry_after) for r in jobs.budget(df, "user_id", 2, 10).collect()}
    assert made == {0: (False, 0.0), 1: (False, 0.0), 2: (True, 1.0), 3: (False, 0.0), 4: (False, 0.0)}


def test_budget_of_a_table_holds_no_group(spark):
    rows = [(u, e, float(e * 37 % 101)) for e in range(300) for u in ((1, 2, None)[e % 3] if e % 5 else 1,)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows stay open over batches
    try:
        spent = jobs.budget(df, "user_id", 2, 10)
        made = {r.event_id: (r.key, r.over, r.retry_after) for r in spent.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, windows = {}, {}
    for u, e, t in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = windows.get(u, (float("-inf"), 0))
        start, n = (t, 1) if t - start >= 10 else (start, n + 1)
        windows[u] = (start, n)
        want[e] = (u, n > 2, start + 10 - t if n > 2 else 0.0)
    assert made == want
    assert "InPandas" not in spent._jdf.queryExecution().toString()
