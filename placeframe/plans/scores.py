"""Queries over area and city scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.config import SCORING
from placeframe.functions import scoring as S
from placeframe.operators import rank, score
from placeframe.plans import views
from placeframe.plans.views import with_

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _case(factor: str, knots: list[tuple[float, float]]) -> str:
    out = f"CASE WHEN {factor} IS NULL THEN NULL WHEN {factor} <= {knots[0][0]} THEN {knots[0][1]}::DOUBLE"
    for (a, p), (b, q) in zip(knots, knots[1:]):
        out += f" WHEN {factor} <= {b} THEN {p} + ({factor} - {a}) / ({b} - {a})::DOUBLE * {q - p}"
    return out + f" ELSE {knots[-1][1]} END AS s_{factor}"


_BANDS = {f.name: list(f.bands) for f in SCORING.factors}
_F = list(_BANDS)


def _scored(preset: str, name: str = "scored") -> str:
    w = SCORING.presets[preset]
    cov = " + ".join(f"CASE WHEN s_{f} IS NULL THEN 0 ELSE {w[f]}::DOUBLE END" for f in _F)
    acc = [f for f in _F if f != "built_up_growth"]
    acc_w = " + ".join(f"CASE WHEN s_{f} IS NULL THEN 0 ELSE {w[f]}::DOUBLE END" for f in acc)
    return f"""{name}_sub AS (SELECT *, {", ".join(_case(f, k) for f, k in _BANDS.items())} FROM cells),
{name}_cov AS (SELECT *, nullif({cov}, 0) AS coverage, nullif({acc_w}, 0) AS acc_w FROM {name}_sub),
{name} AS (SELECT *, {", ".join(f"CASE WHEN {w[f]} > 0 THEN {w[f]}::DOUBLE * s_{f} / coverage END AS p_{f}" for f in _F)},
  ({" + ".join(f"coalesce({w[f]}::DOUBLE * s_{f}, 0)" for f in _F)}) / coverage AS score,
  CASE WHEN coverage > 0 THEN ({" + ".join(f"coalesce({w[f]}::DOUBLE * s_{f}, 0)" for f in acc)}) / acc_w END AS access,
  CASE WHEN coverage > 0 THEN s_built_up_growth END AS momentum FROM {name}_cov)"""


def _city(preset: str) -> str:
    wmean = "sum({0} * pop) / sum(CASE WHEN {0} IS NOT NULL THEN pop END)"
    return f"""{with_("cells", "members")}, {_scored(preset)},
city_scores AS (SELECT m.city, sum(pop) AS people, count(*) AS areas, sum(score * pop) / sum(pop) AS score,
  sum(coverage * pop) / sum(pop) AS coverage, {wmean.format("access")} AS access, {wmean.format("momentum")} AS momentum,
  {", ".join(f"CASE WHEN count(p_{f}) > 0 THEN sum(coalesce(p_{f}, 0) * pop) / sum(pop) END AS p_{f}, {wmean.format('s_' + f)} AS s_{f}" for f in _F)}
  FROM members m JOIN scored USING (cell) WHERE score IS NOT NULL GROUP BY m.city)"""


def _areas(spark: SparkSession, sf_dir: str, preset: str = SCORING.default) -> DataFrame:
    return score.scored_areas(views.cells(spark, sf_dir), SCORING, preset)


def _members(spark: SparkSession, sf_dir: str, preset: str = SCORING.default) -> DataFrame:
    return views.members(spark, sf_dir).join(_areas(spark, sf_dir, preset).drop("city"), "cell")


def _cities(spark: SparkSession, sf_dir: str, preset: str = SCORING.default) -> DataFrame:
    return score.city_scores(_members(spark, sf_dir, preset), SCORING, preset)


def _long(cities: DataFrame) -> DataFrame:
    """city, factor, sub."""
    pairs = [x for f in _F for x in (F.lit(f), F.col(f"s_{f}"))]
    return cities.select("city", F.explode(F.create_map(*pairs)).alias("factor", "sub"))


_TEXT = "array_to_string({}, ',')"


@query(f"""{with_("cells")}, {_scored("balanced")}
SELECT cell, round(score, 9) AS score, round(access, 9) AS access, round(momentum, 9) AS momentum, round(coverage, 9) AS coverage,
  round(0.8 * coverage, 9) AS confidence, {", ".join(f"round(p_{f}, 9) AS p_{f}" for f in _F)} FROM scored""")
def c2_area_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _areas(spark, sf_dir)
    return a.select("cell", *[F.round(c, 9).alias(c) for c in ("score", "access", "momentum", "coverage", "confidence", *(f"p_{f}" for f in _F))])


@query(f"""{with_("cells")}, {_scored("highway")}
SELECT cell, round(score, 9) AS score, round(coverage, 9) AS coverage FROM scored WHERE nh_access IS NULL OR rail_access IS NULL""")
def c2_area_scores_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _areas(spark, sf_dir, "highway").where("nh_access IS NULL OR rail_access IS NULL")
    return a.select("cell", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(f"""{_city("balanced")}
SELECT city, people, areas, round(score, 6) AS score, round(coverage, 6) AS coverage, round(access, 6) AS access, round(momentum, 6) AS momentum,
 {", ".join(f"round(p_{f}, 6) AS p_{f}, round(s_{f}, 6) AS s_{f}" for f in _F)} FROM city_scores""")
def c3_city_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir)
    cols = ("score", "coverage", "access", "momentum", *(f"{x}_{f}" for f in _F for x in "ps"))
    return c.select("city", F.col("people").cast("long"), "areas", *[F.round(x, 6).alias(x) for x in cols])


_LONG = ", ".join(f"('{f}', raw.{f})" for f in _F)
_KM = "CASE factor WHEN 'nh_access' THEN 10 WHEN 'rail_access' THEN 2 WHEN 'metro_access' THEN 2 END"


@query(f"""{with_("cells", "members")},
raw AS (SELECT m.city, c.* EXCLUDE city FROM members m JOIN cells c USING (cell)),
long AS (SELECT raw.city, raw.pop, f.factor, f.value FROM raw, LATERAL (VALUES {_LONG}) AS f(factor, value) WHERE f.value IS NOT NULL),
run AS (SELECT *, sum(pop) OVER (PARTITION BY city, factor ORDER BY value RANGE UNBOUNDED PRECEDING) AS run, sum(pop) OVER (PARTITION BY city, factor) AS total FROM long)
SELECT city, factor, round_even(min(CASE WHEN 2 * run >= total THEN value END), 1) AS value,
  round_even(CASE WHEN {_KM} IS NOT NULL THEN sum(CASE WHEN value <= {_KM} THEN pop ELSE 0 END) / sum(pop)::DOUBLE END, 2) AS share
FROM run GROUP BY city, factor""")
def c4_factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.factor_summary(_members(spark, sf_dir), SCORING)


def _list_sql(kind: str) -> str:
    w = SCORING.presets["balanced"]
    if kind == "drivers":
        rows, where, key, most = ", ".join(f"('{f}', p_{f}, s_{f}, -p_{f})" for f in _F), "s >= 50", "k", 3
    else:
        rows, where, key, most = ", ".join(f"('{f}', p_{f}, s_{f}, -({w[f]}::DOUBLE * (100 - s_{f})))" for f in _F), "s < 40", "k", 2
    return f"""(SELECT coalesce(string_agg(f, ',' ORDER BY {key}, f), '') FROM (SELECT f, k FROM (VALUES {rows}) AS v(f, p, s, k)
      WHERE p IS NOT NULL AND {where} ORDER BY k, f LIMIT {most}))"""


@query(f"""{with_("cells")}, {_scored("balanced")}
SELECT cell, {_list_sql("drivers")} AS drivers, {_list_sql("gaps")} AS gaps FROM scored""")
def w7_drivers_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = score.explained_areas(views.cells(spark, sf_dir), SCORING, "balanced")
    return a.select("cell", F.array_join("drivers", ",").alias("drivers"), F.array_join("gaps", ",").alias("gaps"))


@query(f"""{with_("cells", "members")}, {_scored("balanced")},
m AS (SELECT members.city, cell, pop, score, sum((pop >= 4500)::INT) OVER (PARTITION BY members.city) AS n FROM members JOIN scored USING (cell))
SELECT city, cell, round(score, 6) AS score FROM m WHERE pop >= 4500 OR n < 3
QUALIFY row_number() OVER (PARTITION BY city ORDER BY score DESC, cell) = 1""")
def w8_best_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.best_areas(_members(spark, sf_dir), 4500).withColumn("score", F.round("score", 6))


@query(f"""{_city("balanced")}
SELECT * FROM (SELECT state, city, people, round(score, 6) AS score,
  row_number() OVER (PARTITION BY state ORDER BY score DESC, people DESC, city) AS rank, count(*) OVER (PARTITION BY state) AS total
FROM city_scores JOIN (SELECT n_name AS city, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey) USING (city)) WHERE rank <= 3""")
def q1_cities_of_a_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.read(spark, sf_dir, "region")
    states = views.read(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    out = rank.ranked(_cities(spark, sf_dir).join(states, "city"), ["state"], 3, F.desc("score"), F.desc("people"), "city")
    return out.select("state", "city", F.col("people").cast("long"), F.round("score", 6).alias("score"), F.col("rank").cast("long"), "total")


_NAMES = """names AS (SELECT p_partkey AS id, p_name AS name, list_reverse(string_split(p_name, ' ')) AS aliases, p_size AS people FROM part)"""


@query(f"""WITH {_NAMES}, each AS (SELECT id, people, unnest(list_concat([name], aliases)) AS matched, unnest(range(len(aliases) + 1)) AS pos FROM names),
hit AS (SELECT *, starts_with(lower(matched), 'ri') AS prefix FROM each WHERE contains(lower(matched), 'ri')),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY prefix DESC, pos) = 1)
SELECT id, matched, prefix, people, row_number() OVER (ORDER BY prefix DESC, people DESC, id) AS rank FROM best""")
def q2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.read(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.reverse(F.split("p_name", " ")).alias("aliases"), F.col("p_size").alias("people"))
    return rank.search(names, " Ri ").withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_city("growth")} SELECT city, 'growth' AS preset, round(score, 1) AS score, round(access, 1) AS access, round(momentum, 1) AS momentum FROM city_scores WHERE city = 'NATION_7'""")
def q3_city_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir, "growth").where("city = 'NATION_7'")
    return c.select("city", F.lit("growth").alias("preset"), *[F.round(x, 1).alias(x) for x in ("score", "access", "momentum")])


@query(f"""{with_("cells", "members")}, {_scored("commuter")}
SELECT city, cell, round(score, 6) AS score, rank FROM (SELECT members.city, cell, score, row_number() OVER (PARTITION BY members.city ORDER BY score DESC, pop DESC, cell) AS rank
FROM members JOIN scored USING (cell)) WHERE rank <= 10""")
def q4_areas_of_a_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rank.ranked(_members(spark, sf_dir, "commuter"), ["city"], 10, F.desc_nulls_last("score"), F.desc("pop"), "cell")
    return top.select("city", "cell", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(f"""{_city("balanced")},
base AS (SELECT * FROM city_scores WHERE city = 'NATION_3')
SELECT c.city, round(c.score - b.score, 1) AS delta, rank() OVER (ORDER BY c.score DESC) AS rank FROM city_scores c, base b""")
def q6_compare_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = _cities(spark, sf_dir)
    base = cities.where("city = 'NATION_3'").select(F.col("score").alias("base"))
    out = cities.withColumn("all", F.lit(1)).crossJoin(F.broadcast(base))  # one row
    out = rank.competition_rank(out, ["all"], "score")
    return out.select("city", S.delta(F.col("score") - F.col("base")).alias("delta"), F.col("rank").cast("long"))


@query(f"""{_city("balanced")},
long AS (SELECT city, f, s FROM city_scores, LATERAL (VALUES {", ".join(f"('{f}', s_{f})" for f in _F)}) AS v(f, s)),
d AS (SELECT o.city, o.f AS factor, round(o.s - b.s, 1) AS delta FROM long o JOIN long b ON b.f = o.f AND b.city = 'NATION_3' AND o.city <> 'NATION_3')
SELECT city, factor, delta, delta > 0 AS better FROM d WHERE delta <> 0
QUALIFY row_number() OVER (PARTITION BY city, delta > 0 ORDER BY abs(delta) DESC, factor) <= 2""")
def q6_compare_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(_cities(spark, sf_dir))
    base = long.where("city = 'NATION_3'").drop("city")
    return rank.reasons(base, long.where("city <> 'NATION_3'"), ["city"])


@query("""SELECT r_name AS state, count(n_nationkey) AS cities FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 5 <> 0 GROUP BY r_name""")
def q8_states_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("cities"))
    return views.read(spark, sf_dir, "region").join(n, "r_regionkey", "left").select(F.col("r_name").alias("state"), F.coalesce("cities", F.lit(0)).alias("cities"))


@query(f"""{with_("cells", "members")}, {_scored("balanced", "x")}, {_scored("growth", "y")},
r AS (SELECT m.city, cell, row_number() OVER (PARTITION BY m.city ORDER BY x.score DESC, cell) AS a, row_number() OVER (PARTITION BY m.city ORDER BY y.score DESC, cell) AS b
FROM members m JOIN x USING (cell) JOIN y USING (cell))
SELECT city, count(*) FILTER (a <= 5 AND b <= 5) / 5.0::DOUBLE AS kept FROM r GROUP BY city""")
def w10_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = W.partitionBy("city")
    a = _areas(spark, sf_dir).select("cell", "score")
    b = _areas(spark, sf_dir, "growth").select("cell", F.col("score").alias("other"))
    both = views.members(spark, sf_dir).join(a, "cell").join(b, "cell")
    both = both.withColumns({x: F.row_number().over(city.orderBy(F.desc_nulls_last(c), "cell")) for x, c in (("a", "score"), ("b", "other"))})
    return both.groupBy("city").agg((F.sum(((F.col("a") <= 5) & (F.col("b") <= 5)).cast("int")) / 5.0).alias("kept"))


@query(f"""{with_("cells", "members")}, {_scored("balanced", "x")}, {_scored("highway", "y")},
r AS (SELECT m.city, rank() OVER (w ORDER BY x.score) + (count(*) OVER (PARTITION BY m.city, x.score) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (w ORDER BY y.score) + (count(*) OVER (PARTITION BY m.city, y.score) - 1) / 2.0::DOUBLE AS b
FROM members m JOIN x USING (cell) JOIN y USING (cell) WHERE x.score IS NOT NULL AND y.score IS NOT NULL WINDOW w AS (PARTITION BY m.city))
SELECT city, round(corr(a, b), 6) AS spearman FROM r GROUP BY city""")
def w11_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _areas(spark, sf_dir).select("cell", "score")
    b = _areas(spark, sf_dir, "highway").select("cell", F.col("score").alias("other"))
    both = views.members(spark, sf_dir).join(a, "cell").join(b, "cell").where("score IS NOT NULL AND other IS NOT NULL")

    def average_rank(c: str) -> F.Column:
        ties = F.count(F.lit(1)).over(W.partitionBy("city", c))
        return F.rank().over(W.partitionBy("city").orderBy(c)) + (ties - 1) / 2.0

    return both.select("city", average_rank("score").alias("a"), average_rank("other").alias("b")).groupBy("city").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(f"""{with_("cells", "members")}, {_scored("balanced")},
m AS (SELECT members.city, cell, score, 'area ' || (cell % 40) AS label FROM members JOIN scored USING (cell)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY city, label ORDER BY score DESC, cell) = 1)
SELECT city, label, cell FROM b QUALIFY row_number() OVER (PARTITION BY city ORDER BY score DESC, cell) <= 5""")
def w9_top_areas_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir).withColumn("label", F.concat(F.lit("area "), F.col("cell") % 40))
    best = rank.first_per(m, ["city", "label"], F.desc_nulls_last("score"), "cell")
    return rank.ranked(best, ["city"], 5, F.desc_nulls_last("score"), "cell").select("city", "label", "cell")


@query(f"""{_city("balanced")} SELECT city, CASE WHEN people >= 2500000 THEN 'metro' WHEN people >= 1000000 THEN 'large' ELSE 'emerging' END AS tier,
 round(score, 1) AS score, people FROM city_scores""")
def s19_city_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir)
    return c.select("city", S.tier(F.col("people")).alias("tier"), F.round("score", 1).alias("score"), F.col("people").cast("long")).orderBy(F.desc("score"), F.desc("people"), "city")
