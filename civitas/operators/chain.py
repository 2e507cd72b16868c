"""The collection chain: pages of registered sources to validated, stored and counted events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions import quality, scoring, text
from civitas.operators import collect, joins, pages, store
from civitas.staging import staged

# Characters of a name, least of one that is stored, and the category of collected events.
MOST_NAME, LEAST_NAME, CATEGORY = 200, 2, "local_event"


@dataclass
class Collected:
    """What a collection gives: the merged events, venues that had to be made for them, the new rows as they were judged (with
    ``reason`` where one isn't stored), the quality log, and a run for each enabled source."""

    events: DataFrame
    venues: DataFrame
    judged: DataFrame
    log: DataFrame
    runs: DataFrame


def rows_of_cards(cards: DataFrame, now: Column) -> DataFrame:
    """Event rows of cards (``pages.FIELDS``, source_name, venue_name, category): the id follows from the venue and the title."""
    title = F.substring("title", 1, MOST_NAME)
    low = F.concat_ws(" ", "title", "description")
    scores = F.to_json(F.struct(*(F.round(c, 4).alias(k) for k, c in scoring.keyword_scores(low, scoring.EVENT_KEYWORDS, 2.0).items())))
    return cards.select(
        F.concat(store.slug(F.col("venue_name")), F.lit("_"), F.md5("title")).alias("external_id"), F.col("source_name").alias("provider"), title.alias("name"), "description", F.lit(CATEGORY).alias("category"), F.col("category").alias("subcategory"),
        text.parse_time(F.col("date"), F.col("time"), now).cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), "venue_name", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("string").alias("address"),
        F.col("url").alias("source_url"), "price", "image_url", scores.alias("psychographic_relevance"), "page_id", "place",
    )


def judged(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` with why one isn't stored (``reason``, null if it is) and what the validators say, which keep nothing out: is_valid and quality_score."""
    reason = F.when(F.coalesce(F.char_length(F.trim("name")), F.lit(0)) < LEAST_NAME, "missing or invalid name").when(F.coalesce("external_id", F.lit("")) == "", "missing external_id")
    verdict = quality.verdict(quality.event_rules(now))
    return rows.withColumn("reason", reason).withColumn("verdict", verdict).select(*rows.columns, "reason", F.col("verdict.is_valid").alias("is_valid"), F.col("verdict.score").alias("quality_score"))


def with_place(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """``rows`` without a place get that of the located venue that their venue's name means (see ``joins.match_names``), and its address if they have none."""
    located = venues.where("lat IS NOT NULL AND lng IS NOT NULL AND name <> ''")
    asked = rows.where("venue_name <> ''").select(F.col("venue_name").alias("query")).distinct()
    best = joins.match_names(asked, located.select(F.col("venue_id").alias("place_id"), "name"))
    own = located.groupBy(F.col("venue_id").alias("place_id")).agg(F.first(F.struct(F.col("lat").alias("v_lat"), F.col("lng").alias("v_lng"), F.col("address").alias("v_address"))).alias("v"))
    both = rows.join(best.join(own, "place_id").select("query", "v"), F.col("venue_name") == F.col("query"), "left")
    none = F.col("lat").isNull() & F.col("lng").isNull()
    found = {"lat": F.when(none, F.col("v.v_lat")).otherwise(F.col("lat")), "lng": F.when(none, F.col("v.v_lng")).otherwise(F.col("lng")), "address": F.when(none, F.coalesce("address", F.col("v.v_address"))).otherwise(F.col("address"))}
    return both.select(*(found[c].alias(c) if c in found else F.col(c) for c in rows.columns))


def collect_events(crawled: DataFrame, sources: DataFrame, events: DataFrame, venues: DataFrame, now: Column) -> Collected:
    """One collection: cards of the acceptable pages ``crawled`` (page_id, url, html) of enabled ``sources`` (source_name, host, venue_name, category,
    is_enabled, and where they have their own, selectors) become event rows, are judged, placed, tied to venues and merged into ``events`` on
    (external_id, provider); of rows with one key the card that comes last counts. A row that isn't stored stays in ``judged`` with its reason."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    own = sources.where("is_enabled").select("source_name", "host", "venue_name", "category", *(["selectors"] if "selectors" in sources.columns else []))
    good = crawled.where(text.acceptable(F.col("html"), collect.LEAST)).select("page_id", "url", "html", host.alias("host")).join(own, "host")
    # a source's columns are joined to the cards again, so that the parser reads no more than it needs
    cards = pages.event_cards(good.select(F.struct("page_id", "source_name").alias("page_id"), "url", "html", *(["selectors"] if "selectors" in own.columns else [])))
    cards = cards.withColumn("source_name", F.col("page_id.source_name")).withColumn("page_id", F.col("page_id.page_id")).join(own.select("source_name", "venue_name", "category"), "source_name")
    rows = staged(judged(rows_of_cards(cards, now), now), "judged_events")
    kept = store.latest(rows.where("reason IS NULL"), ["external_id", "provider"], [F.desc("page_id"), F.desc("place")])
    placed, made = store.resolve_venues(staged(with_place(kept, venues), "placed_events"), venues)
    if "event_id" in events.columns:
        kind = events.schema["event_id"].dataType
        own_id = store.stable_id(F.col("provider"), F.col("external_id")) if kind.simpleString() == "string" else F.xxhash64("provider", "external_id").cast(kind)
        placed = placed.withColumn("event_id", own_id)
    placed = placed.withColumn("venue_id", F.col("venue_id").cast(events.schema["venue_id"].dataType))
    log = store.quality_log(rows.withColumn("record", F.concat_ws(":", "provider", "external_id")), "events", "record", quality.event_rules(now), now)
    return Collected(store.upsert_events(events, placed.drop("venue_name", "reason", "is_valid", "quality_score", "page_id", "place"), now), made, rows, log, collect.runs_of(sources, rows.where("reason IS NULL"), now))
