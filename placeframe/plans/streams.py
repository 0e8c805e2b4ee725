"""Queries that run a stream over the rows of a given table, which arrive in several batches, or publish and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.plans.views import read
from placeframe.sources import writers
from placeframe.storage import shared_folder
from placeframe.streaming import jobs
from placeframe.streaming.keyed import KeyedTable

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _in_thirds(rows: DataFrame, by: str) -> list[DataFrame]:
    """The rows in three tables that arrive one after the other, in the order of a number."""
    low, high = rows.select(F.expr(f"approx_percentile({by}, array(0.33, 0.66))").alias("q")).first().q or (0, 0)
    return [rows.where(f"{by} <= {low}"), rows.where(f"{by} > {low} AND {by} <= {high}"), rows.where(f"{by} > {high} OR {by} IS NULL")]


_TOPIC = "coalesce(source, '') || ':' || lower(split_part(coalesce(text, ''), ' ', 1))"


@query(f"""SELECT topic, doc_id, n_chars FROM (SELECT {_TOPIC} AS topic, doc_id, n_chars FROM documents)
 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n_chars DESC NULLS LAST, doc_id DESC) = 1""")
def st2_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three batches; for each topic (source and first word) the longest is kept, of equal ones the later."""
    docs = read(spark, sf_dir, "documents").select(F.expr(_TOPIC).alias("topic"), "doc_id", "n_chars")
    folder = _folder(spark, "upsert")
    kept = KeyedTable(spark, f"{folder}/table", docs.schema, ["topic"], ("n_chars", "doc_id"))
    stream = jobs.arrivals([t.coalesce(1) for t in _in_thirds(docs, "doc_id")], f"{folder}/in")
    jobs.finished(kept.sink(stream, f"{folder}/checkpoint"))
    return kept.read()


@query("""SELECT doc_id, n_chars FROM documents""")
def st1_document_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third of the documents arrives with all that arrived before it; only unseen ids are taken in, as they came first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a, b, c = _in_thirds(docs, "doc_id")
    again = lambda t: t.withColumn("n_chars", F.lit(-1).cast(docs.schema["n_chars"].dataType))
    folder = _folder(spark, "intake")
    taken = KeyedTable(spark, f"{folder}/table", docs.schema, ["doc_id"])
    stream = jobs.arrivals([t.coalesce(1) for t in (a, b.unionByName(again(a)), c.unionByName(again(a)).unionByName(again(b)))], f"{folder}/in")
    jobs.finished(taken.sink(stream, f"{folder}/checkpoint"))
    return taken.read()


@query("""SELECT event_id, user_id, ts FROM events""")
def st1_unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in order of time, those of each batch twice; state inside the watermark lets each through once."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    timed = events.withColumn("at", F.unix_micros("ts"))
    folder = _folder(spark, "unseen")
    stream = jobs.arrivals([t.unionByName(t).drop("at").coalesce(1) for t in _in_thirds(timed, "at")], f"{folder}/in")
    out = jobs.appended(jobs.unseen(stream, "event_id"), folder)
    return out.withColumn("ts", F.col("ts").cast(read(spark, sf_dir, "events").schema["ts"].dataType))


# each event after the one before it of its user: start of the window it falls into, and its place in that
_SPEND = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, t, i, t AS start_t, 1::BIGINT AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, CASE WHEN e.t - r.start_t >= 86400 THEN e.t ELSE r.start_t END, CASE WHEN e.t - r.start_t >= 86400 THEN 1 ELSE r.n + 1 END
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, event_id, n > 3 AS "over", CASE WHEN n > 3 THEN start_t + 86400 - t ELSE 0.0 END::DOUBLE AS retry_after FROM r"""


@query(_SPEND)
def st3_request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.budget(read(spark, sf_dir, "events"), "user_id", 3, 86_400)


@query(_SPEND)
def st3_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget with state by key: events arrive in order of time, in three batches over which windows stay open."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts"))
    folder = _folder(spark, "budget")
    stream = jobs.arrivals([t.drop("at").coalesce(1) for t in _in_thirds(events, "at")], f"{folder}/in")
    with jobs.keyed_state(spark):
        return jobs.appended(jobs.budget(stream, "user_id", 3, 86_400), folder)


@query("""SELECT user_id, date_trunc('day', ts) AS day, CASE WHEN count(*) >= 2 THEN count(*) END AS n FROM events GROUP BY 1, 2""")
def st4_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of days, as events arrive in three batches; each batch's changed windows are merged into a keyed table."""
    events = read(spark, sf_dir, "events").select("user_id", "ts")
    timed = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    folder = _folder(spark, "windows")
    stream = jobs.arrivals([t.drop("at").coalesce(1) for t in _in_thirds(timed, "at")], f"{folder}/in")
    counts = jobs.windowed_counts(stream, "user_id", "1 day", late="2 days")
    held = KeyedTable(spark, f"{folder}/table", counts.schema, ["user_id", "start"], ("n",))
    jobs.finished(held.sink(counts, f"{folder}/checkpoint").outputMode("update"))
    return held.read().select("user_id", F.col("start").cast(read(spark, sf_dir, "events").schema["ts"].dataType).alias("day"), F.when(F.col("n") >= 2, F.col("n")).alias("n"))


@query("""SELECT n_nationkey AS k, n_name AS name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation
 LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def s15_published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers published twice as one set, the second time whole, and counted from what readers see."""
    folder = _folder(spark, "published")
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    writers.publish({"customers": c.limit(1), "suppliers": s.limit(1)}, folder)
    writers.publish({"customers": c, "suppliers": s}, folder)
    seen = writers.published(spark, folder)
    customers = seen["customers"].groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    suppliers = seen["suppliers"].groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return nations.join(customers, "k", "left").join(suppliers, "k", "left").fillna(0, ["customers", "suppliers"])
