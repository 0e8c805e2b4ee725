"""Line dedup: drop the lines whose normalised form stands in too many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.llm.columns import ascii_lower, digest, strip
from placeframe.llm.scratch import release, table

LEAST_CHARS, LEAST_DOCUMENTS = 1, 10


def _dropped(docs: DataFrame, least_documents: int, least_chars: int) -> DataFrame:
    """row (all columns of docs as one struct, so that none can clash with a name made here), lines, n_lines, n_dropped, kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), digest(text).alias("t"), text.alias("text"))
    key = ascii_lower(strip(F.col("line")))
    lines = keyed.select("id", "t", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("key", key)
    lines = table(lines.where(F.length("key") >= least_chars).select("id", "t", "at", digest(F.col("key")).alias("k")), "lines")
    # once for each document, and then pre-aggregated by key before the shuffle: a line of many documents is no hot key
    seen = lines.where("id IS NOT NULL").select("k", "id").distinct()
    common = seen.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents).drop("n")
    # written, so that its size decides how it is joined: broadcast, or by a shuffle whose hot keys can be split
    common = table(common, "common")
    places = lines.join(common, "k").groupBy("id", "t").agg(F.collect_set("at").alias("places"))
    places = table(places, "places")
    release(lines, common)
    same = F.col("m.id").eqNullSafe(F.col("p.id")) & (F.col("m.t") == F.col("p.t"))
    joined = keyed.alias("m").join(places.alias("p"), same, "left").select("row", F.split("text", "\n").alias("lines"), F.array_sort("places").alias("places"))
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"), lambda at: F.get("lines", at))
    )
    return joined.select("row", F.array_join(kept, "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def _columns(docs: DataFrame, made: dict[str, Column]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made] + [v.alias(k) for k, v in made.items()]


def drop_common_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_dropped` (long) added; columns of docs with these names give way.

    A line's key is the line stripped of white space at both ends, A-Z in lower case. Keys of at least `least_chars`
    code points found in at least `least_documents` documents lose all their lines everywhere; a document counts once
    for each key. Rows that repeat a doc_id are one document; a row without doc_id is none, and loses its lines as
    others do. Repeated rows repeat. Null or empty text is one empty line; what text is left of a row that loses all is
    empty. Lines are hashed once; only hashes and places are shuffled for the count, and each text once, to meet its
    own places, by doc_id and text. A very long text is one array of lines in memory. An empty table gives an empty result.
    """
    out = _dropped(docs, least_documents, least_chars)
    return out.select(*_columns(docs, {"kept_text": F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}))


def dedup_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of docs with the common lines gone from text, and n_chars, if there is one, to match; null text stays null.
    All other columns, of whatever names, are as they were."""
    out = _dropped(docs, least_documents, LEAST_CHARS)
    text = F.when(F.col("row").getField("text").isNotNull(), F.col("kept"))
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*_columns(docs, made)).select(*docs.columns)
