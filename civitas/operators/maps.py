"""Layers of a map as rows: venues with their prediction, events, predictions, heat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions import scoring as sc
from civitas.operators import geo

LAYER = ("layer", "id", "lat", "lng", "radius", "colour", "tooltip")
_LOCATED = "lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0"


def percent(share: Column) -> Column:
    """A share as people read it: 0.25 is 25.0%; null stays null."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", sc.rounded(share * 100, 1)))


def venue_markers(venues: DataFrame, best: DataFrame, scheme: str = "default") -> DataFrame:
    """A marker for each located venue: ``LAYER``, its ``popup`` and the ``prediction`` section of ``best`` (venue_id, prediction_value,
    confidence_score, one row a venue; null where there is none). A null rating counts as 3 of 5, and is shown as N/A; a value or
    confidence that is missing is shown as 0."""
    own = best.select(F.col("venue_id").alias("p_venue"), F.struct(F.coalesce("prediction_value", F.lit(0.0)).alias("value"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence")).alias("p"))
    both = venues.where(_LOCATED).join(own, F.col("venue_id") == F.col("p_venue"), "left")
    style = sc.marker(F.coalesce(F.nullif("avg_rating", F.lit(0.0)), F.lit(3.0)) / 5, scheme)
    popup = sc.venue_popup()
    value, section = F.col("p.value"), F.struct(sc.prediction_colour(F.col("p.value")).alias("colour"), percent(F.col("p.value")).alias("likelihood"), percent(F.col("p.confidence")).alias("confidence"))
    shown = F.concat(F.lit("Venue: "), F.coalesce("name", F.lit("Unknown")), F.lit(" | Rating: "), popup["rating"], F.coalesce(F.concat(F.lit(" | ML Prediction: "), percent(value)), F.lit("")))
    return both.select(F.lit("venue").alias("layer"), F.col("venue_id").alias("id"), "lat", "lng", style["radius"].alias("radius"), style["colour"].alias("colour"), shown.alias("tooltip"), popup.alias("popup"), F.when(F.col("p").isNotNull(), section).alias("prediction"))


def event_markers(events: DataFrame, venues: DataFrame, scheme: str = "default") -> DataFrame:
    """``LAYER`` of each event whose venue is located."""
    style = sc.marker(F.lit(0.5), scheme)
    placed = events.select("event_id", "venue_id", "name").join(venues.where(_LOCATED).select("venue_id", "lat", "lng"), "venue_id")
    return placed.select(F.lit("event").alias("layer"), F.col("event_id").alias("id"), "lat", "lng", style["radius"].alias("radius"), style["colour"].alias("colour"), F.concat(F.lit("Event: "), "name").alias("tooltip"))


def heat_points(predictions: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, lat, lng, intensity) of the predictions of located venues, from 0.1 to 1 of the largest; values of 0 and below go."""
    placed = predictions.select(F.col("prediction_id").alias("id"), "venue_id", "prediction_value").join(venues.where(_LOCATED).select("venue_id", "lat", "lng"), "venue_id")
    return geo.intensity(placed, "prediction_value").select("id", "lat", "lng", "intensity")


def combined(venues: DataFrame, events: DataFrame, predictions: DataFrame, best: DataFrame) -> DataFrame:
    """All layers in one table: ``LAYER`` and the ``intensity`` of points of the heat layer, which have no marker."""
    kinds = dict(zip(LAYER, ("string", "long", "double", "double", "int", "string", "string")))
    heat = heat_points(predictions, venues).withColumns({"layer": F.lit("heat")} | {c: F.lit(None).cast(kinds[c]) for c in ("radius", "colour", "tooltip")})
    layers = [df.withColumn("intensity", F.lit(None).cast("double")) for df in (venue_markers(venues, best), event_markers(events, venues))]
    return reduce(DataFrame.unionByName, [df.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), "intensity") for df in (*layers, heat)])


def centre(*layers: DataFrame) -> DataFrame:
    """One row: the mean place of all located rows of ``layers`` (lat, lng), or the default where none is."""
    return geo.centre(reduce(DataFrame.unionByName, [df.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng") for df in layers]))
