"""Quality rules: lines that too many documents of one host share, and documents that little is left of without them.

Native: every step is a DataFrame function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.llm.columns import SPACE, ascii_lower, digest, strip, words
from placeframe.llm.scratch import release, table


@dataclass(frozen=True)
class Rules:
    """A line is boilerplate of a host if at least `least_documents` of its documents have it and more than `line_share`
    of them. A document is depleted when, without such lines, it keeps fewer than `least_words` words, less than
    `least_share` of its words or less than `least_lines` of its lines (those with a word)."""

    least_documents: int = 5
    line_share: float = 0.05
    least_share: float = 0.2
    least_lines: float = 0.5
    least_words: int = 50
    repeat_share: float = 0.5


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to the rows of docs, and n_text_lines:
    lines with a word.

    Null text counts as empty. n_repeat_words: words covered by three-word windows found twice or more. Where hashes of two
    windows of a text are equal, the text's windows are compared by their words.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumns({"_text": text, "_w": words(text)})
    base = base.withColumns(
        {
            "_h": F.when(
                F.size("_w") >= 3,
                F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: F.translate(line, SPACE, "") != ""),
        }
    )
    # only texts with a repeated hash pay for the sort; words hold no blank, so windows with one text have the same words
    base = base.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", F.slice("_w", i + 1, 3)).alias("g"), i.alias("at")))),
        ),
    )
    base = base.withColumn("_at", F.sort_array(F.filter(F.transform("_s", _where_repeated), lambda at: at.isNotNull())))
    covered = F.aggregate(
        F.transform("_at", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate("_text", SPACE, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_text_lines": F.size("_lines").cast("long"),
        }
    ).drop("_text", "_w", "_h", "_lines", "_s", "_at")


def _where_repeated(e: Column, j: Column) -> Column:
    """The window's place if its neighbour in the order of hashes and words is the same window."""
    same = (F.get("_s", j - 1)["g"] == e["g"]) | (F.get("_s", j + 1)["g"] == e["g"])
    return F.when(same, e["at"])


def _keyed(docs: DataFrame) -> DataFrame:
    """row: all columns of docs as one struct, so that none can clash with a name made here; id, host, t, text."""
    t = digest(F.coalesce(F.col("text").cast("string"), F.lit("")))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), host.alias("host"), t.alias("t"), F.col("text").cast("string").alias("text"))


def common_lines(keyed: DataFrame, rules: Rules) -> DataFrame:
    """id, host, t, places and n_common: where the lines above the host's limit are, and how many words they hold.

    keyed: id, host, t, text. A line counts once for each document (id) of the host; rows without id are no
    document of their own. Lines are hashed once, into a written table; counts are pre-aggregated before the shuffle by line.
    """
    lines = keyed.where(F.col("text").isNotNull()).select("id", "host", "t", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("key", ascii_lower(strip(F.col("line")))).where(F.col("key") != "")
    lines = table(lines.select("id", "host", "t", "at", digest(F.col("key")).alias("l"), F.size(words(F.col("line"))).alias("n")), "lines")
    seen = lines.where("id IS NOT NULL").select("host", "l", "id").distinct()
    often = seen.groupBy("host", "l").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= rules.least_documents)
    hosts = table(keyed.where("id IS NOT NULL").select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")), "hosts")
    # written, so that its size decides how it is joined: broadcast, or by a shuffle whose hot keys can be split
    common = often.join(hosts, "host").where(F.col("documents") > rules.line_share * F.col("of"))
    common = table(common.select("host", "l"), "common")
    places = lines.join(common, ["host", "l"]).select("id", "host", "t", "at", "n").distinct()
    places = places.groupBy("id", "host", "t").agg(F.collect_list("at").alias("places"), F.sum("n").alias("n_common"))
    places = table(places, "places")
    release(lines, common, hosts)
    return places


def _same(a: str, b: str) -> Column:
    same = F.lit(True)
    for c in ("id", "host", "t"):
        same &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the measures, n_common_lines, n_common (words in common lines), base_failed and kept.

    docs needs doc_id, text and source; other columns pass through, but for those that have a name of the result's own:
    the result's win. Null text is empty and so fails; null source is the host ''. Repeated rows are judged alike, each
    once; rows that repeat a doc_id are one document of the host. Ties: a line on the limit is no boilerplate. A very
    long text is one array of words in memory. An empty table gives an empty result.
    """
    keyed = _keyed(docs)
    places = common_lines(keyed.drop("row"), rules)
    measured = text_measures(keyed)
    failed = (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") > rules.repeat_share * F.col("n_words"))
    n_common = F.coalesce("p.n_common", F.lit(0)).cast("long")
    left = F.col("n_words") - n_common
    n_common_lines = F.coalesce(F.size("p.places"), F.lit(0)).cast("long")
    depleted = (left < rules.least_words) | (left < rules.least_share * F.col("n_words")) | (F.col("n_text_lines") - n_common_lines < rules.least_lines * F.col("n_text_lines"))
    made = [
        *MEASURES,
        n_common_lines.alias("n_common_lines"),
        n_common.alias("n_common"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
    ]
    own = [c for c in docs.columns if c not in (*MEASURES, "n_common_lines", "n_common", "base_failed", "kept")]
    joined = measured.alias("m").join(places.alias("p"), _same("m", "p"), "left")
    return joined.select(*(F.col("m.row").getField(c).alias(c) for c in own), *made)


def without_common_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, their text without the lines above the limits of their host; null text stays null."""
    keyed = _keyed(docs)
    joined = keyed.alias("m").join(common_lines(keyed.drop("row"), rules).alias("p"), _same("m", "p"), "left")
    kept = F.filter(F.split("m.text", "\n"), lambda line, at: ~F.array_contains("p.places", at))
    text = F.when(F.col("p.places").isNull(), F.col("m.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("m.row").getField(c).alias(c) for c in docs.columns))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns, of whatever names.

    The verdicts are written without the texts and then picked out from docs: a filter right on the measures would be
    pushed into them and compute each measure again wherever it is named.
    """
    keyed = _keyed(docs)
    narrow = keyed.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), "text", "t")
    verdicts = table(judge(narrow, rules).select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "t", "kept"), "verdicts")
    kept = verdicts.where("kept").drop("kept").distinct()
    return keyed.alias("m").join(kept.alias("p"), _same("m", "p"), "left_semi").select("row.*")
