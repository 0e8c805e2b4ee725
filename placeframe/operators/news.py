"""News items to planned projects: every item gives a project for each city it names, or one reason why not."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.functions import text
from placeframe.operators.mentions import said_in
from placeframe.operators.rank import first_per
from placeframe.storage import table


@dataclass(frozen=True)
class Desk:
    """How items are read. stages: (pattern, stage), the first that fits decides, and the stage `excluded` drops the item;
    modes: mode -> pattern, of which exactly one must fit. Patterns are taken in any case."""

    stages: tuple[tuple[str, str], ...]
    modes: Mapping[str, str]
    skip_hosts: tuple[str, ...] = ()
    reference_titles: str | None = None
    max_age_days: int | None = None
    base: float = 0.5
    dated: float = 0.2
    stated: float = 0.1
    review_below: float = 0.0


def extracted(items: DataFrame, cities: DataFrame, desk: Desk) -> DataFrame:
    """item, reason, id, city, mode, stage, name, evidence, event_date, cost_crore, length_km, source_ref, fetched_at, confidence.

    items(item, title, url, description, date, fetched_at): item is unique, fetched_at a date. cities(city, name, aliases).
    A row with a reason is an item left out, all else null; one without is a project, one for each city named. Figures
    count only where the quoted sentence states them. Null texts are empty. Texts are read once; those of items that are
    left out early go no further.
    """
    title, url, more = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "url", "description"))
    said = F.trim(F.concat_ws("\n", title, more))
    iso = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("date", 1, 10).try_cast("date"))
    rows = items.select("item", "fetched_at", title.alias("title"), url.alias("url"), said.alias("text"), F.coalesce(iso, text.url_date(url).try_cast("date")).alias("event_date"))
    fits = lambda c, pattern: F.col(c).rlike(f"(?i){pattern}")
    rule = F.coalesce(*[F.when(fits("text", p), i) for i, (p, _) in enumerate(desk.stages)])
    modes = F.array_compact(F.array(*[F.when(fits("text", p), F.lit(m)) for m, p in desk.modes.items()]))
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    rows = rows.withColumns({"rule": rule, "modes": modes, "host": host})
    rows = rows.withColumn("stage", F.coalesce(*[F.when(F.col("rule") == i, F.lit(s)) for i, (_, s) in enumerate(desk.stages)]))
    skipped = F.lit(False)
    for d in desk.skip_hosts:
        skipped |= (F.col("host") == d) | F.endswith("host", F.lit(f".{d}"))
    early = F.when((F.col("title") == "") | ~F.col("url").rlike("^https?://"), "no_title_or_link").when(skipped, "not_news_source")
    if desk.reference_titles:
        early = early.when(fits("title", desk.reference_titles), "reference_page")
    if desk.max_age_days is not None:
        early = early.when(F.datediff("fetched_at", "event_date") > desk.max_age_days, "stale")
    early = early.when(F.col("rule").isNull(), "no_stage_rule").when(F.col("stage") == "excluded", "not_upcoming")
    early = early.when(F.size("modes") == 0, "no_mode").when(F.size("modes") > 1, "ambiguous_mode")
    parts = F.split("text", r"\n|(?<=[.!?])\s+")
    with_ = lambda p: F.filter(parts, lambda s: F.rlike(s, F.lit(f"(?i){p}")))
    quote = F.coalesce(*[F.when(F.col("rule") == i, F.trim(F.get(with_(p), 0))) for i, (p, _) in enumerate(desk.stages)])
    going = lambda c: F.when(F.col("early").isNull(), F.col(c)).alias(c)
    rows = rows.withColumn("early", early).select("item", "fetched_at", "event_date", "rule", "stage", "modes", "early", *[going(c) for c in ("title", "url", "text")], F.when(F.col("early").isNull(), quote).alias("evidence"))
    rows = table(rows, "items")

    spoken = cities.select(F.col("city").alias("key"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("said"))
    named = said_in(rows.where("early IS NULL").select(F.col("item").alias("id"), "text"), spoken).select(F.col("id").alias("item"), F.col("key").alias("city"))
    quoted = F.when(F.col("early").isNull(), text.quoted_in(F.col("evidence"), F.col("text")))
    rows = rows.withColumn("quoted", F.coalesce(quoted, F.lit(False)))
    rows = rows.withColumns({"cost_crore": text.cost_crore(F.col("evidence")), "length_km": text.length_km(F.col("evidence"))})
    rows = rows.drop("text").join(named, "item", "left")

    one = lambda c: c.cast("int")
    stated = F.col("cost_crore").isNotNull() | F.col("length_km").isNotNull()
    rows = rows.withColumn("confidence", F.round(desk.base + desk.dated * one(F.col("event_date").isNotNull()) + desk.stated * one(stated), 3))
    reason = F.coalesce(
        F.col("early"),
        F.when(F.col("city").isNull(), "no_configured_city"),
        F.when(~F.col("quoted"), "quote_not_in_source"),
        F.when(F.col("confidence") < desk.review_below, "low_confidence"),
    )
    rows = rows.withColumn("reason", reason)
    mode = F.get("modes", 0)
    given = {
        "id": F.concat_ws("-", "city", mode, F.substring(F.sha1("url"), 1, 8)), "city": F.col("city"), "mode": mode, "stage": F.col("stage"), "name": text.normal_form(F.col("title")),
        "evidence": F.col("evidence"), "event_date": F.col("event_date"), "cost_crore": F.col("cost_crore"), "length_km": F.col("length_km"), "source_ref": F.col("url"), "fetched_at": F.col("fetched_at"), "confidence": F.col("confidence"),
    }
    return rows.select("item", "reason", *[F.when(F.col("reason").isNull(), c).alias(n) for n, c in given.items()])


def projects(found: DataFrame) -> DataFrame:
    """One row for each project id of extracted(): the most confident, of equal ones that of the later item."""
    return first_per(found.where("reason IS NULL").drop("reason"), ["id"], F.desc("confidence"), F.desc("item"))


def rejects(found: DataFrame) -> DataFrame:
    """item, reason of the items that gave no project."""
    return found.where("reason IS NOT NULL").select("item", "reason")
