"""From pages to stored events, on pages whose cards are known."""

from datetime import datetime

from pyspark.sql import functions as F

from civitas.operators import chain

EVENTS = "event_id string, venue_id string, external_id string, provider string, name string, description string, category string, subcategory string, start_time timestamp_ntz, end_time timestamp_ntz, psychographic_relevance string, lat double, created_at timestamp_ntz, updated_at timestamp_ntz"


def _page(*cards):
    return "<body>" + "".join(cards) + "<!--" + "x" * 500 + "--></body>"


def _card(title, date="", rest=""):
    return f'<div class="event"><div class="inner"><h3>{title}</h3></div><span class="date">{date}</span>{rest}</div>'


def test_a_collection_from_pages_to_the_store(spark):
    now = F.lit(datetime(2025, 11, 20)).cast("timestamp_ntz")
    crawled = spark.createDataFrame([
        (1, "https://a.org/events", _page(_card("Jazz networking night", "Dec 5, 2025 7:30 PM", "<p>A long and fine description.</p><a href='/e/1'>more</a>"), _card("Quiet evening"))),
        (2, "https://a.org/more", _page(_card("Jazz networking night", "December 6 2025"), _card("no"))),
        (3, "https://b.org/", _page("<ul><li class=gig><a href='x'>Loud gig</a></li></ul>")), (4, "https://off.org/", _page(_card("Never read"))), (5, "https://a.org/", _card("Page too short")), (6, "https://c.org/", _page("<p>nothing</p>")), (7, "https://none.org/", _page(_card("No source"))), (8, "https://a.org/n", None),
    ], "page_id long, url string, html string")
    sources = spark.createDataFrame([("s_a", "a.org", "The Hall", "music", True, None), ("s_b", "b.org", "New Room", "bar", True, [".gig"]), ("s_c", "c.org", "The Hall", "art", True, None), ("s_off", "off.org", "Off", "x", False, None)], "source_name string, host string, venue_name string, category string, is_enabled boolean, selectors array<string>")
    venues = spark.createDataFrame([("v2", "THE HALL", 39.2, -94.7, "late street"), ("v1", "the hall", 39.1, -94.6, "first street"), ("v0", "The hall", None, None, None)], "venue_id string, name string, lat double, lng double, address string")
    key = "the_hall_" + spark.range(1).select(F.md5(F.lit("Quiet evening")).alias("k")).first().k
    held = spark.createDataFrame([("own", "v9", key, "s_a", "old name", "old text", "music", None, datetime(2020, 1, 1), None, None, 1.0, datetime(2020, 1, 1), None), ("other", "v9", "z", "s_z", "stays", None, "music", None, None, None, None, None, datetime(2020, 1, 1), None)], EVENTS)
    got = chain.collect_events(crawled, sources, held, venues, now)
    assert got.events.columns == held.columns
    rows = {r.name: r for r in got.events.collect()}
    assert set(rows) == {"Jazz networking night", "Quiet evening", "Loud gig", "stays"}
    jazz, quiet, gig = rows["Jazz networking night"], rows["Quiet evening"], rows["Loud gig"]
    assert (jazz.start_time, jazz.provider, jazz.subcategory, jazz.category, jazz.venue_id, jazz.lat) == (datetime(2025, 12, 6), "s_a", "music", "local_event", "v0", 39.1)
    assert (quiet.event_id, quiet.description, quiet.start_time, quiet.created_at, quiet.updated_at, quiet.venue_id) == ("own", None, None, datetime(2020, 1, 1), datetime(2025, 11, 20), "v0")
    made = got.venues.collect()
    assert [(r.name, r.provider, r.category) for r in made] == [("New Room", "s_b", "event_venue")] and gig.venue_id == made[0].venue_id and gig.lat is None
    judged = sorted(((r.name, r.reason, r.source_url, r.start_time) for r in got.judged.collect()), key=str)
    assert judged == [("Jazz networking night", None, "https://a.org/e/1", datetime(2025, 12, 5, 19, 30)), ("Jazz networking night", None, None, datetime(2025, 12, 6)), ("Loud gig", None, "https://b.org/x", None), ("Quiet evening", None, None, None)]
    assert all(0 < r.quality_score <= 1 and r.is_valid == (r.start_time is not None) for r in got.judged.collect())
    assert {r.field_name for r in got.log.where("record_id LIKE 's_b:%'").collect()} >= {"start_time"}
    assert {r.source_name: (r.success, r.records) for r in got.runs.collect()} == {"s_a": (True, 3), "s_b": (True, 1), "s_c": (False, 0)}
    again = chain.collect_events(crawled, sources, got.events, venues.unionByName(got.venues.select(venues.columns)), now)
    same = lambda df: sorted(map(tuple, df.drop("updated_at").collect()), key=str)
    assert same(again.events) == same(got.events) and again.venues.count() == 0


def test_rows_that_are_not_stored_keep_their_reason(spark):
    now = F.lit(datetime(2025, 11, 20)).cast("timestamp_ntz")
    rows = spark.createDataFrame([("a", " x "), ("", "fine name"), ("c", None), ("d", "ok name")], "external_id string, name string")
    cards = rows.select("external_id", F.lit("s").alias("provider"), "name", *(F.lit(None).cast(t).alias(c) for c, t in (("description", "string"), ("category", "string"), ("subcategory", "string"), ("start_time", "timestamp_ntz"), ("end_time", "timestamp_ntz"), ("psychographic_relevance", "string"))))
    assert {r.external_id: r.reason for r in chain.judged(cards, now).collect()} == {"a": "missing or invalid name", "": "missing external_id", "c": "missing or invalid name", "d": None}


def test_an_empty_collection(spark):
    now = F.lit(datetime(2025, 11, 20)).cast("timestamp_ntz")
    crawled = spark.createDataFrame([], "page_id long, url string, html string")
    sources = spark.createDataFrame([("s", "a.org", "Hall", "music", True)], "source_name string, host string, venue_name string, category string, is_enabled boolean")
    venues = spark.createDataFrame([], "venue_id string, name string, lat double, lng double, address string")
    got = chain.collect_events(crawled, sources, spark.createDataFrame([], EVENTS), venues, now)
    assert got.events.count() == got.judged.count() == got.log.count() == got.venues.count() == 0
    assert [(r.source_name, r.success) for r in got.runs.collect()] == [("s", False)]
