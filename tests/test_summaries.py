"""Summaries, map layers and enrichment stores on hard rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civitas.operators import maps, store, summaries

NOW = dt.datetime(2024, 1, 15)
VENUE = "venue_id long, name string, category string, avg_rating double, address string, provider string, lat double, lng double"
BEST = "venue_id long, prediction_value double, confidence_score double"


def now():
    return F.lit("2024-01-15").cast("timestamp_ntz")


def test_venue_markers_show_what_is_missing(spark):
    rows = [
        (1, "Hall", "bar", 4.5, "Main St", "p", 39.1, -94.6), (2, None, None, None, None, None, 39.2, -94.5), (3, "Lost", "bar", 5.0, None, "p", None, -94.5),
        (4, "Sea", "bar", 5.0, None, "p", 0.0, 0.0), (5, "Low", "bar", 0.0, None, "p", 39.0, -94.4),
    ]
    best = [(1, 0.7, 0.255), (5, None, None), (9, 0.9, 0.9)]
    m = {r.id: r for r in maps.venue_markers(spark.createDataFrame(rows, VENUE), spark.createDataFrame(best, BEST)).collect()}
    assert sorted(m) == [1, 2, 5]
    assert (m[1].radius, m[1].tooltip) == (12, "Venue: Hall | Rating: 4.5 | ML Prediction: 70.0%")
    assert (m[1].prediction.colour, m[1].prediction.confidence) == ("#d73027", "25.5%")
    assert (m[2].radius, m[2].tooltip, m[2].prediction) == (10, "Venue: Unknown | Rating: N/A", None)
    assert m[2].popup.asDict() == {"name": "Unknown Venue", "category": "Unknown", "address": "N/A", "provider": "Unknown", "rating": "N/A"}
    # a rating of 0 counts as none, a prediction without a value as 0
    assert (m[5].radius, m[5].prediction.colour, m[5].prediction.likelihood) == (10, "#91bfdb", "0.0%")


def test_combined_map_holds_every_layer_and_survives_empty_ones(spark):
    v = spark.createDataFrame([(1, "Hall", "bar", 4.5, "Main St", "p", 39.1, -94.6), (2, "Lost", "bar", 4.5, "Main St", "p", None, None)], VENUE)
    e = spark.createDataFrame([(7, 1, "Jazz"), (8, 2, "Nowhere"), (9, None, "None")], "event_id long, venue_id long, name string")
    p = spark.createDataFrame([(20, 1, 0.4), (21, 1, 0.02), (22, 1, 0.0), (23, 2, 0.9)], "prediction_id long, venue_id long, prediction_value double")
    best = spark.createDataFrame([(1, 0.4, 0.5)], BEST)
    out = {(r.layer, r.id): r for r in maps.combined(v, e, p, best).collect()}
    assert sorted(out) == [("event", 7), ("heat", 20), ("heat", 21), ("venue", 1)]
    assert (out["heat", 20].intensity, out["heat", 21].intensity, out["heat", 20].radius) == (1.0, 0.1, None)
    assert maps.combined(v.limit(0), e, p, best).count() == 0
    assert maps.centre(v.limit(0), v.where("lat IS NULL")).first()[:] == (39.0997, -94.5786)


def test_summaries_of_empty_and_partly_null_tables(spark):
    v = spark.createDataFrame([(1.0, 2.0, NOW - dt.timedelta(days=7)), (1.0, None, NOW - dt.timedelta(days=8)), (None, None, None)], "lat double, lng double, created_at timestamp_ntz")
    none = spark.createDataFrame([], "created_at timestamp_ntz")
    one = summaries.data_summary(v, none, none, none, none, none, now()).first()
    assert (one.total_venues, one.located_venues, one.recent_venues, one.total_events, one.recent_events) == (3, 1, 1, 0, 0)
    assert one.location_completeness == pytest.approx(1 / 3)
    assert summaries.data_summary(v.limit(0), none, none, none, none, none, now()).first().location_completeness == 0
    p = spark.createDataFrame([(0.5, None, NOW - dt.timedelta(hours=23)), (None, 0.5, NOW - dt.timedelta(days=1)), (1.0, 1.0, None)], "prediction_value double, confidence_score double, generated_at timestamp_ntz")
    models = spark.createDataFrame([("v1", NOW), ("v2", NOW), ("v0", None)], "version string, trained_at timestamp_ntz")
    one = summaries.prediction_summary(p, models, now()).first()
    assert (one.total_predictions, one.recent_predictions, one.avg_prediction_value, one.avg_confidence, one.model_version, one.model_exists) == (3, 1, 0.5, 0.5, "v2", True)
    one = summaries.prediction_summary(p.limit(0), models.limit(0), now()).first()
    assert (one.total_predictions, one.avg_confidence, one.model_version, one.model_exists) == (0, 0.0, None, False)


def test_visit_trends_need_the_very_hour_before(spark):
    at = lambda day, hour, n: [(1, NOW + dt.timedelta(days=day, hours=hour, minutes=m)) for m in range(n)]
    rows = at(0, 5, 2) + at(0, 6, 3) + at(0, 8, 1) + at(7, 6, 6) + [(2, NOW), (None, NOW), (3, None)]
    out = {(r.venue_id, r.hour): r[2:] for r in summaries.visit_trends(spark.createDataFrame(rows, "venue_id long, timestamp timestamp_ntz")).collect()}
    hour = lambda day, h: (1, NOW + dt.timedelta(days=day, hours=h))
    assert out == {hour(0, 5): (2, None, None), hour(0, 6): (3, 50.0, None), hour(0, 8): (1, None, None), hour(7, 6): (6, None, 100.0), (2, NOW): (1, None, None)}


def test_enrichment_stores(spark):
    demo = "lat double, lng double, census_tract string, median_income double, data_source string"
    held = spark.createDataFrame([(1.0, 2.0, None, 5.0, "x"), (1.0, 2.0, "a", 6.0, "x")], demo)
    out = store.upsert_demographics(held, spark.createDataFrame([(1.0, 2.0, None)], "lat double, lng double, census_tract string"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1.0, 2.0, "a", 6.0, "x"), (1.0, 2.0, None, None, "census_bureau")]
    said = spark.createDataFrame([(1, 3, 4)], "venue_id long, mention_count long, total_engagement long")
    out = store.append_sentiment(said, spark.createDataFrame([(1, None), (None, 2)], "venue_id long, mention_count long"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 0), (1, 3, 4), (None, 2, 0)]
    known = "address string, lat double, lng double, formatted_address string, access_count long, country string"
    held = spark.createDataFrame([("a", 1.0, 1.0, "A", 9, "DE"), ("b", 1.0, 1.0, "B", 9, "DE")], known)
    new = spark.createDataFrame([("b", 3.0, 3.0, "B2"), ("b", 2.0, 2.0, "B1"), ("c", 4.0, 4.0, None)], "address string, lat double, lng double, formatted_address string")
    assert sorted(map(tuple, store.geocode_set(held, new).collect())) == [("a", 1.0, 1.0, "A", 9, "DE"), ("b", 2.0, 2.0, "B1", 0, "USA"), ("c", 4.0, 4.0, None, 0, "USA")]


def test_demographics_of_one_place_without_a_tract_stay_apart(spark):
    demo = "demo_id long, lat double, lng double, census_tract string, data_source string"
    held = spark.createDataFrame([(1, 1.0, 2.0, None, "x"), (2, 1.0, 2.0, None, "x"), (3, 1.0, 2.0, "a", "x")], demo)
    out = store.upsert_demographics(held, spark.createDataFrame([(1, 1.0, 2.0, None), (4, 1.0, 2.0, "a")], "demo_id long, lat double, lng double, census_tract string"))
    assert out.columns == held.columns
    assert sorted((r.demo_id, r.data_source) for r in out.collect()) == [(1, "census_bureau"), (2, "x"), (4, "census_bureau")]
