"""Readers with optional filters, and one row by its id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Filters = dict[str, Any]
Predicate = Callable[[Any], Column]

_located = lambda on: F.col("lat").isNotNull() & F.col("lng").isNotNull() if on else F.lit(True)
VENUE_FILTERS: dict[str, Predicate] = {"category": lambda x: F.col("category") == x, "has_location": _located, "min_rating": lambda x: F.col("avg_rating") >= x}
#: Corners of a box: min_lat, max_lat, min_lng, max_lng; those that are given count.
_box = lambda x: reduce(Column.__and__, (F.col(side) >= x[f"min_{side}"] if f"min_{side}" in x else F.lit(True) for side in ("lat", "lng")), reduce(Column.__and__, (F.col(side) <= x[f"max_{side}"] if f"max_{side}" in x else F.lit(True) for side in ("lat", "lng"))))
#: Whether any of a venue's scores (JSON of name to number) is at least a value.
_any_score = lambda x: F.exists(F.map_values(F.from_json("psychographic_relevance", "map<string,double>")), lambda v: v >= x)
VENUE_FILTERS |= {"bounds": _box, "provider": lambda x: F.col("provider") == x, "psychographic_min": _any_score}
EVENT_FILTERS: dict[str, Predicate] = {"category": lambda x: F.col("category") == x, "start_date": lambda x: F.col("start_time") >= F.lit(x).cast("timestamp_ntz"), "end_date": lambda x: F.col("start_time") <= F.lit(x).cast("timestamp_ntz"), "has_location": _located}
SENTIMENT_FILTERS: dict[str, Predicate] = {k: lambda x, k=k: F.col(k) == x for k in ("venue_id", "event_id", "platform")}


def read(df: DataFrame, known: dict[str, Predicate], filters: Filters | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """``df`` under the ``filters`` that are set (None, empty and 0: not set), in ``order``, up to ``limit`` rows.

    A filter that isn't ``known`` is an error, as it would otherwise be dropped without a word. A limit
    with an order is a top-k, so no whole sort is needed.
    """
    unknown = sorted(set(filters or {}) - set(known))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    for name, value in (filters or {}).items():
        if value:
            df = df.where(known[name](value))
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def get_venues(venues: DataFrame, filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    return read(venues, VENUE_FILTERS, filters, limit=limit)


def get_events(events: DataFrame, venues: DataFrame, filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    """Events with their venue's name, place and address, latest first."""
    own = venues.select("venue_id", F.col("name").alias("venue_name"), "lat", "lng", "address")
    return read(events.join(own, "venue_id", "left"), EVENT_FILTERS, filters, [F.desc("start_time"), F.col("event_id")], limit)


def get_predictions(predictions: DataFrame, venues: DataFrame, venue_ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Predictions with their venue's name and place, of all venues or those given: a list, or a table of
    many (venue_id), which is joined."""
    if isinstance(venue_ids, DataFrame):
        predictions = predictions.join(venue_ids.select("venue_id").distinct(), "venue_id", "left_semi")
    elif venue_ids:
        predictions = predictions.where(F.col("venue_id").isin(venue_ids))
    return predictions.join(venues.select("venue_id", F.col("name").alias("venue_name"), "lat", "lng"), "venue_id", "left").orderBy(F.desc("prediction_value"), "prediction_id")


def by_id(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row whose ``key`` is ``value``, which reaches the scan as a filter; none if there is none."""
    return df.where(F.col(key) == value)


def ask(df: DataFrame, sql: str, name: str = "rows", **values: Any) -> DataFrame:
    """A statement over ``df`` under ``name`` with values for its parameters (``:name``), never pasted into the text."""
    return df.sparkSession.sql(sql, args=values, **{name: df})
