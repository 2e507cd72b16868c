"""One-row summaries of the store and of its predictions, and trends of visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(time: str, now: Column, days: int) -> Column:
    return F.count_if(F.col(time) >= now - F.make_dt_interval(days=F.lit(days)))


def data_summary(venues: DataFrame, events: DataFrame, predictions: DataFrame, demographics: DataFrame, weather: DataFrame, traffic: DataFrame, now: Column) -> DataFrame:
    """One row: how many of each, how many venues are located and how many of the rows came in the last 7 days; each table is read once."""
    both = F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    parts = [
        venues.agg(F.count("*").alias("total_venues"), both.alias("located_venues"), _within("created_at", now, 7).alias("recent_venues")),
        events.agg(F.count("*").alias("total_events"), _within("created_at", now, 7).alias("recent_events")),
        *(df.agg(F.count("*").alias(n)) for df, n in ((predictions, "total_predictions"), (demographics, "demographic_records"), (weather, "weather_records"), (traffic, "traffic_records"))),
    ]
    one = reduce(lambda a, x: a.join(F.broadcast(x)), parts)  # one row each
    return one.withColumns({"location_completeness": F.col("located_venues") / F.greatest("total_venues", F.lit(1)), "timestamp": now})


def prediction_summary(predictions: DataFrame, models: DataFrame, now: Column) -> DataFrame:
    """One row: how many predictions, how many of the last day, their mean value and confidence (a missing one counts as 0), and the newest of
    ``models`` (version, trained_at), null where there is none."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    recent = F.count_if(F.col("generated_at") > now - F.make_dt_interval(days=F.lit(1)))
    one = predictions.agg(F.count("*").alias("total_predictions"), recent.alias("recent_predictions"), mean("confidence_score").alias("avg_confidence"), mean("prediction_value").alias("avg_prediction_value"), F.max("generated_at").alias("last_updated"))
    newest = models.agg(F.max_by("version", F.struct("trained_at", "version")).alias("model_version"), (F.count("*") > 0).alias("model_exists"))
    return one.join(F.broadcast(newest))  # one row each


def visit_trends(visits: DataFrame) -> DataFrame:
    """(venue_id, hour, visit_count, trend_vs_previous_hour, trend_vs_same_time_last_week): the visits (venue_id, timestamp) of each venue's hours that have any,
    and by how many percent they exceed those of the hour, and the week, before; null where there were none then.

    Visits are counted before they are ordered: a venue has a row an hour at most, however many visits.
    """
    hours = visits.where("venue_id IS NOT NULL AND timestamp IS NOT NULL").groupBy("venue_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("visit_count"))
    number = F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600)
    line = Window.partitionBy("venue_id").orderBy("number")

    def against(back: int) -> Column:
        before = F.sum("visit_count").over(line.rangeBetween(-back, -back))
        return (F.col("visit_count") - before) * 100.0 / before

    return hours.withColumn("number", number).select("venue_id", "hour", "visit_count", against(1).alias("trend_vs_previous_hour"), against(168).alias("trend_vs_same_time_last_week"))
