"""Queries that read the whole documents as news items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.operators import news
from placeframe.plans.views import read

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_WORDS = ("than", "thre", "thor", "thed", "erin", "thly", "thou")
_STAGES = (("(^|[ \n])thble($|[ .,\n])", "excluded"), ("(^|[ \n])thnt($|[ .,\n])", "tender"), ("(^|[ \n])(th|er)(sh|ing)($|[ .,\n])", "approved"))
_MODES = {"metro": "(^|[ \n])(ther|anea)($|[ .,\n])", "rail": "(^|[ \n])(de|que)($|[ .,\n])"}
_DESK = news.Desk(_STAGES, _MODES, ("wiki.example",), "[0-9]", 300, 0.5, 0.25, 0.125, 0.5)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted from each document: its first line as title, its text, a link and a date by its number."""
    k = F.col("doc_id")
    link = F.concat(F.lit("https://news.example/2024/0"), k % 9 + 1, F.lit("/1"), k % 9, F.lit("/"), k)
    url = F.when(k % 7 == 0, "ftp://x").when(k % 5 == 0, "https://m.wiki.example/a").otherwise(link)
    date = F.when(k % 3 == 0, F.concat(F.lit("2024-0"), k % 9 + 1, F.lit("-05T10:00:00"))).when(k % 3 == 1, "yesterday")
    docs = read(spark, sf_dir, "documents")
    items = docs.select(k.alias("item"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), url.alias("url"), F.col("text").alias("description"), date.alias("date"), F.lit("2024-12-31").cast("date").alias("fetched_at"))
    n = read(spark, sf_dir, "nation")
    words = F.array(*[F.lit(w) for w in _WORDS])
    cities = n.select(F.col("n_nationkey").cast("string").alias("city"), F.col("n_name").alias("name"), F.array(F.get(words, (F.col("n_nationkey") % len(_WORDS)).cast("int"))).alias("aliases"))
    return news.extracted(items, cities, _DESK)


def _sql_when(table: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN '{v}'" for p, v in table) + " END"


_EDGE = r"[^\p{L}\p{N}\p{M}_]"
_SQL = rf"""WITH i AS (SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title, trim(coalesce(text, '')) AS body,
 CASE WHEN doc_id % 7 = 0 THEN 'ftp' WHEN doc_id % 5 = 0 THEN 'wiki' ELSE 'news' END AS host, 'https://news.example/2024/0' || (doc_id % 9 + 1) || '/1' || (doc_id % 9) || '/' || doc_id AS url FROM documents),
j AS (SELECT *, trim(title || chr(10) || body) AS said, CASE WHEN doc_id % 3 = 0 THEN make_date(2024, (doc_id % 9 + 1)::INT, 5) WHEN host = 'news' THEN make_date(2024, (doc_id % 9 + 1)::INT, (10 + doc_id % 9)::INT) END AS event_date FROM i),
k AS (SELECT *, {_sql_when(_STAGES)} AS stage, regexp_matches(said, '(?i){_MODES["metro"]}') AS metro, regexp_matches(said, '(?i){_MODES["rail"]}') AS rail FROM j),
l AS (SELECT *, CASE WHEN title = '' OR host = 'ftp' THEN 'no_title_or_link' WHEN host = 'wiki' THEN 'not_news_source' WHEN regexp_matches(title, '[0-9]') THEN 'reference_page'
 WHEN date_diff('day', event_date, DATE '2024-12-31') > 300 THEN 'stale' WHEN stage IS NULL THEN 'no_stage_rule' WHEN stage = 'excluded' THEN 'not_upcoming' WHEN NOT metro AND NOT rail THEN 'no_mode' WHEN metro AND rail THEN 'ambiguous_mode' END AS early FROM k),
c AS (SELECT n_nationkey::VARCHAR AS city, unnest([n_name, [{", ".join(f"'{w}'" for w in _WORDS)}][(n_nationkey % {len(_WORDS)} + 1)::INT]]) AS spelt FROM nation),
m AS (SELECT DISTINCT doc_id, city FROM l JOIN c ON early IS NULL AND contains(lower(said), lower(spelt)) AND regexp_matches(said, '(?i)(^|{_EDGE})' || spelt || '($|{_EDGE})')),
r AS (SELECT l.*, city, CASE WHEN early IS NULL AND city IS NULL THEN 'no_configured_city' ELSE early END AS reason FROM l LEFT JOIN m USING (doc_id))
"""


@query(_SQL + """SELECT city || '-' || CASE WHEN metro THEN 'metro' ELSE 'rail' END || '-' || substring(sha1(url), 1, 8) AS id, city, stage, doc_id AS item, event_date, CASE WHEN event_date IS NULL THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence FROM r WHERE reason IS NULL""")
def c14_projects_of_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each city that a document names, the most confident of each id."""
    return news.projects(_found(spark, sf_dir)).select("id", "city", "stage", "item", "event_date", "confidence")


@query(_SQL + "SELECT doc_id AS item, reason FROM r WHERE reason IS NOT NULL")
def c14_rejected_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document with the one reason for which it was left out."""
    return news.rejects(_found(spark, sf_dir))
