"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir.

    Where it is unset, a fresh local folder on a local master, as in tests; on a cluster an error, as executors don't
    see a folder of the driver's machine.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share (master {master})")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not the jobs that made it. The files go with
    release(), or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """table() in buckets of a key: groups by that key are read from it without a shuffle, if the session's number of
    shuffle partitions is no more than the buckets. The catalog knows it until release()."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    out = spark.table(name)
    out._scratch_path, out._scratch_name = path, name
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by table(), once all that was computed from them is written itself."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if name := getattr(t, "_scratch_name", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            system, where = _at(t.sparkSession, path)
            system.delete(where, True)


def stored_bytes(t: DataFrame) -> int:
    """Bytes of the files of a table made by table()."""
    system, where = _at(t.sparkSession, t._scratch_path)
    return system.getContentSummary(where).getLength()


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
