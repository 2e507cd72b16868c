"""Keyword scores, fit, labels, event adjustments, marker styles and type maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by dimension, for events and for venues.
EVENT_KEYWORDS = {
    "career_driven": ["networking", "professional", "business", "career", "corporate", "conference", "seminar", "workshop", "training"],
    "competent": ["expert", "masterclass", "training", "certification", "skill", "advanced", "professional", "workshop"],
    "fun": ["party", "celebration", "festival", "concert", "nightlife", "drinks", "social", "entertainment", "music", "dance", "comedy"],
    "social": ["social", "community", "meetup", "gathering", "group", "networking"],
    "adventurous": ["adventure", "outdoor", "extreme", "challenge", "exploration", "sports", "hiking", "climbing"],
}
VENUE_KEYWORDS = {
    "career_driven": ["networking", "professional", "business", "corporate", "conference"],
    "competent": ["expert", "masterclass", "training", "certification", "skill", "advanced"],
    "fun": ["party", "celebration", "festival", "concert", "nightlife", "entertainment", "music", "dance"],
    "social": ["social", "community", "meetup", "gathering", "group"],
    "adventurous": ["adventure", "outdoor", "extreme", "challenge", "exploration"],
}
# Label boosts, event factors, type map, marker colours by score.
LABEL_BOOST = {"restaurant": 0.1, "bar": 0.2, "nightclub": 0.3, "theater": 0.0, "museum": -0.1, "sports_venue": 0.2}
EVENT_FACTOR = {"music": 1.2, "concert": 1.3, "festival": 1.4, "sports": 1.1, "theater": 0.9, "business": 0.7}
TYPE_CATEGORY = {
    "restaurant": "restaurant", "bar": "bar", "night_club": "nightclub", "cafe": "restaurant", "museum": "museum", "art_gallery": "gallery", "movie_theater": "theater", "shopping_mall": "shopping", "gym": "recreation",
    "spa": "recreation", "book_store": "cultural", "library": "cultural", "park": "recreation", "stadium": "sports_venue", "bowling_alley": "recreation", "casino": "entertainment", "amusement_park": "entertainment",
}
MARKERS = [(0.8, 12), (0.6, 10), (0.4, 8), (0.2, 6), (None, 4)]
SCHEMES = {
    "default": ["#d73027", "#fc8d59", "#fee08b", "#e0f3f8", "#91bfdb"],
    "api": ["#08519c", "#3182bd", "#6baed6", "#9ecae1", "#c6dbef"],
    "scraped": ["#00441b", "#238b45", "#66c2a4", "#b2e2ab", "#edf8e9"],
    "calculated": ["#a50f15", "#de2d26", "#fb6a4a", "#fc9272", "#fcbba1"],
    "ground_truth": ["#4a1486", "#6a51a3", "#9e9ac8", "#cbc9e2", "#f2f0f7"],
}


def literal_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def keyword_scores(text: Column, keywords: dict[str, list[str]], weight: float = 1.0) -> dict[str, Column]:
    """min(weight * hits / keywords, 1) for each dimension, of the lower-cased text (null: empty)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {k: F.least(hits(low, words) * weight / len(words), F.lit(1.0)) for k, words in keywords.items()}


def fit(career: Column, competent: Column, fun: Column) -> Column:
    return career * 0.35 + competent * 0.30 + fun * 0.35


def label(rating: Column, category: Column, lat: Column, lng: Column, noise: Column | float = 0.0) -> Column:
    """1 if the clipped rule of rating, category and location exceeds a half; a null rating gives 0."""
    boost = F.coalesce(F.try_element_at(literal_map(LABEL_BOOST), F.coalesce(category, F.lit(""))), F.lit(0.0))
    place = F.when(lat.isNotNull() & lng.isNotNull(), 0.1).otherwise(-0.2)
    p = F.least(F.greatest((rating - 1) / 4 + boost + place + noise, F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(F.round(p, 9) > 0.5, F.lit(False)), 1).otherwise(0)


def noise(key: Column, width: float, seed: int = 42) -> Column:
    """A number within ``width`` of zero that follows from key and seed: the same in every run, whatever the partitions."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000 - 0.5) * 2 * width


def event_popup() -> Column:
    """What an event's marker shows, of name, venue_name, category, start_time and provider."""
    shown = {"name": "Unknown Event", "venue_name": "Unknown", "category": "Unknown", "start_time": "TBD", "provider": "Unknown"}
    return F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c) for c, other in shown.items()))


def venue_popup() -> Column:
    """What a venue's marker shows, of name, category, avg_rating, address and provider."""
    shown = {"name": "Unknown Venue", "category": "Unknown", "address": "N/A", "provider": "Unknown"}
    return F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c) for c, other in shown.items()), F.coalesce(F.round("avg_rating", 1).cast("string"), F.lit("N/A")).alias("rating"))


def prediction_colour(value: Column) -> Column:
    """The colour of a prediction's section in a venue's popup."""
    # fixed values: least prediction and colour
    return F.when(value >= 0.7, "#d73027").when(value >= 0.5, "#fc8d59").when(value >= 0.3, "#fee08b").otherwise("#91bfdb")


def prediction_popup() -> Column:
    """What a prediction's marker shows, of prediction_value, confidence_score, prediction_type and model_version."""
    value = F.format_string("%.3f", F.coalesce("prediction_value", F.lit(0.5)))
    other = {"confidence_score": "N/A", "prediction_type": "Unknown", "model_version": "Unknown"}
    return F.struct(value.alias("prediction_value"), *(F.coalesce(F.col(c).cast("string"), F.lit(o)).alias(c) for c, o in other.items()))


def event_adjustment(category: Column, start: Column) -> Column:
    """Category factor times hour factor, at most 2; hour 22 is still evening."""
    h = F.hour(start)
    by_hour = F.when(h.isNull(), 1.0).when(h.between(18, 22), 1.2).when(h.between(12, 17), 1.0).when((h >= 23) | (h <= 6), 0.8).otherwise(0.7)
    return F.least(F.coalesce(F.try_element_at(literal_map(EVENT_FACTOR), F.lower(F.coalesce(category, F.lit("")))), F.lit(1.0)) * by_hour, F.lit(2.0))


def area_density(category: Column) -> Column:
    low = F.lower(category)
    return F.when(low.isin("nightclub", "bar", "restaurant"), "high_density").when(low.isin("theater", "music_venue", "sports_venue"), "medium_density").otherwise("low_density")


def type_category(types: Column) -> Column:
    """The category of the first type that has one."""
    known = literal_map(TYPE_CATEGORY)
    first = F.try_element_at(F.filter(types, lambda t: F.map_contains_key(known, t)), F.lit(1))
    return F.coalesce(F.try_element_at(known, first), F.lit("local_venue"))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: scaled, to the nearest whole number (halves away from zero), scaled back. Spark's own round
    goes by the decimal digits that a double is written with, so 0.5005 becomes 0.501 there and 0.5 here, as it lies below the half."""
    scale = F.lit(float(10**digits))
    return F.round(c * scale) / scale


def marker(score: Column, scheme: str = "default") -> Column:
    """(radius, colour) of a score's bucket in a colour scheme."""
    out = None
    for (least, radius), colour in reversed(list(zip(MARKERS, SCHEMES[scheme]))):
        made = F.struct(F.lit(radius).alias("radius"), F.lit(colour).alias("colour"))
        out = made if out is None else F.when(score >= least, made).otherwise(out)
    return out
