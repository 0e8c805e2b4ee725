"""Jobs that run on a stream and, with the same expressions, on a table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle


def _timed(events: DataFrame) -> DataFrame:
    """A watermark needs a timestamp with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, width: str, late: str | None = None, least: int = 1) -> DataFrame:
    """key, start, n of tumbling windows over ts; counts below `least` are null. On a stream, `late` bounds the wait."""
    own = _timed(events).withWatermark("ts", late) if late else events
    counts = own.groupBy(F.window("ts", width), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("window.start").alias("start"), F.when(F.col("n") >= least, F.col("n")).alias("n"))


def latest(events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, ts and values of the newest event of each key."""
    return events.groupBy(key).agg(F.max("ts").alias("ts"), *[F.max_by(v, "ts").alias(v) for v in values])


def unseen(docs: DataFrame, key: str = "doc_id", late: str = "1 day") -> DataFrame:
    """A stream's rows whose key has not come before inside the watermark on ts."""
    return _timed(docs).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def arrivals(tables: list[DataFrame], folder: str, files: int = 1) -> DataFrame:
    """A stream of the rows of tables that arrive one after the other, `files` files at a time."""
    spark = tables[0].sparkSession
    for t in tables:
        t.write.mode("append").parquet(folder)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def finished(writer: DataStreamWriter) -> None:
    """Runs a stream over all that has arrived, batch by batch, and ends."""
    writer.trigger(availableNow=True).start().awaitTermination()


def appended(rows: DataFrame, folder: str) -> DataFrame:
    """What a stream, run over all that has arrived, appends: each row once, whatever is done again."""
    finished(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint"))
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state by key needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class _Budget(StatefulProcessor):
    """A window opens with a key's first event; events beyond the limit inside it are over budget."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (float("-inf"), 0)
        events = pd.concat(rows).sort_values(["at", "event_id"])
        out, start, n = spend(events, start, n, self.limit, self.seconds)
        self.state.update((start, n))
        out.insert(0, "key", key[0])
        yield out

    def close(self) -> None:
        pass


def spend(events: pd.DataFrame, start: float, n: int, limit: int, seconds: float) -> tuple[pd.DataFrame, float, int]:
    """event_id, over, retry_after of one key's ordered events, and the window they leave open."""
    rows = []
    for event, at in zip(events["event_id"], events["at"], strict=True):
        start, n, over, after = step(at, start, n, limit, seconds)
        rows.append((event, over, after))
    return pd.DataFrame(rows, columns=["event_id", "over", "retry_after"]), start, n


def step(at: float, start: float, n: int, limit: int, seconds: float) -> tuple[float, int, bool, float]:
    """start and n of the window after an event, and the event's over and retry_after."""
    if at - start >= seconds:
        start, n = at, 0
    n += 1
    return start, n, n > limit, start + seconds - at if n > limit else 0.0


_SPENT = "key long, event_id long, over boolean, retry_after double"


def budget(events: DataFrame, key: str, limit: int, seconds: float) -> DataFrame:
    """key, event_id, over, retry_after for events(event_id, ts): on a table or, with state by key, on a stream.

    A table's rows are walked in order of key and time; only the open window goes from batch to batch, so no key's events
    are held together.
    """
    own = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    if own.isStreaming:
        return own.groupBy("key").transformWithStateInPandas(_Budget(limit, seconds), outputStructType=_SPENT, outputMode="Append", timeMode="None")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = object(), float("-inf"), 0
        for batch in batches:
            over, after = [], []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if key != last:
                    last, start, n = key, float("-inf"), 0
                start, n, o, a = step(float("nan") if at is None else at, start, n, limit, seconds)
                over.append(o)
                after.append(None if math.isnan(a) else a)
            columns = [batch.column("key"), batch.column("event_id"), pa.array(over, pa.bool_()), pa.array(after, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "event_id", "over", "retry_after"])

    order = ["key", F.col("at").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    return own.repartition("key").sortWithinPartitions(*order).mapInArrow(fold, _SPENT)
