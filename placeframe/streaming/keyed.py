"""A table of one row a key that batches are merged into, each of them once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from placeframe.sources.commits import Commits


class KeyedTable:
    """For each value of `keys` one row of all that was merged: the one whose `prefer` (expressions, compared in their
    order) is largest, null being the least. Without `prefer` the row that came first stays: an intake of unseen keys.

    Rows lie in `buckets` by a hash of the keys. A batch reads and writes only the buckets that it has rows for; a commit
    record then says, for each bucket, which folder holds it. A batch that stopped before its record has changed nothing, and
    is done again; one that has its record is skipped. Of folders that no record needs any more those stay that the record
    before named, for readers that began with it. One writer at a time, as a stream is. Rows that tie in all of
    `prefer` are told apart by chance: let it be total. Null is a key like others. A key's rows are aggregated before they
    are shuffled, and large buckets are written by several tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], prefer: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.schema, self.keys, self.prefer, self.buckets = spark, schema, keys, prefer, buckets
        self.folder = folder.rstrip("/")
        self.commits = Commits(spark, folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{at}/_bucket={b}" for b, at in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows of the newest record."""
        return self._rows(self.commits.last()[1].get("held", {}))

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Merge the rows of batch number `batch`; numbers rise. A number that has its record, or a smaller one, is skipped."""
        last, record = self.commits.last()
        if batch <= last:
            return
        held = record.get("held", {})
        rows = rows.select(*self.schema.names)
        touched = sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # as many as buckets at most
        both = self._rows(held, touched).withColumn("_held", F.lit(True)).unionByName(rows.withColumn("_held", F.lit(False)))
        best = F.max_by(F.struct(*self.schema.names), F.struct(*map(F.expr, self.prefer or ("_held",))))
        kept = both.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).agg(best.alias("_row")).select("_row.*").withColumn("_bucket", self._bucket())
        at = f"data/{batch}-{uuid.uuid4().hex}"
        if touched:
            kept.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{at}")
        self._commit(batch, held | {str(b): at for b in touched}, held)

    def _commit(self, batch: int, held: dict[str, str], before: dict[str, str]) -> None:
        self.commits.add(batch, {"held": held})
        used = {at.removeprefix("data/") for at in (*held.values(), *before.values())}
        for name in self.commits.folders("data"):
            if name not in used:
                self.commits.delete(f"data/{name}")
        self.commits.forget(self.commits.numbers()[-2:][0])

    def sink(self, batches: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream's batches merged one after the other; start() it with a trigger."""
        return batches.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
