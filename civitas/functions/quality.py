"""Record validators as column expressions: each rule is a struct (is_valid, field, error, warning, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories that pass, the city's box, the score dimensions.
VENUE_CATEGORIES = ["restaurant", "bar", "nightclub", "theater", "museum", "gallery", "music_venue", "sports_venue", "shopping", "hotel", "event_venue", "entertainment", "recreation", "cultural", "local_venue", "major_venue"]
EVENT_CATEGORIES = ["music", "theater", "sports", "food", "art", "business", "cultural", "nightlife", "outdoor", "family", "local_event", "major_event"]
CITY = {"lat": (38.5, 39.5), "lng": (-95.0, -94.0)}
DIMENSIONS = ["career_driven", "competent", "fun", "social", "adventurous"]
# What a URL looks like, in either case of letters, and a model's version.
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
VERSION = r"^v?\d+(\.\d+)*$"


def rule(field: str, *cases: tuple[Column, bool, float, str | None, bool], score: float = 1.0) -> Column:
    """The first case that holds: (condition, is_valid, score, message, message is a warning); else valid with ``score``."""
    def made(valid: bool, points: float, message: str | None, warning: bool) -> Column:
        text = F.lit(message).cast("string")
        none = F.lit(None).cast("string")
        return F.struct(F.lit(valid).alias("is_valid"), F.lit(field).alias("field"), (none if warning else text).alias("error"), (text if warning else none).alias("warning"), F.lit(float(points)).alias("score"))

    out = made(True, score, None, False)
    for when, *rest in reversed(cases):
        out = F.when(when, made(*rest)).otherwise(out)
    return out


def required(c: Column, field: str) -> Column:
    return rule(field, (c.isNull() | (F.trim(c.cast("string")) == ""), False, 0.0, "missing", False))


def name(c: Column, field: str = "name") -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    n = F.char_length(s)
    return rule(field, (n < 2, False, 0.2, "too short", False), (n > 200, False, 0.3, "too long", False), (~s.rlike("[a-zA-Z]"), False, 0.4, "no letters", False), (n < 5, True, 0.7, None, False), (n > 100, True, 0.8, None, False))


def description(c: Column) -> Column:
    n = F.char_length(F.trim(F.coalesce(c, F.lit(""))))
    return rule("description", (n < 10, False, 0.6, "too short", True), (n > 2000, False, 0.3, "too long", False), (n < 50, True, 0.7, None, False))


def category(c: Column, known: list[str]) -> Column:
    low = F.lower(F.trim(c))
    return rule("category", (low.isNull() | ~low.isin(known), False, 0.5, "unknown category", True))


def coordinate(c: Column, field: str) -> Column:
    x, most = c.cast("string").try_cast("double"), {"lat": 90, "lng": 180}[field]
    low, high = CITY[field]
    return rule(field, (x.isNull(), False, 0.0, "not a number", False), (~x.between(-most, most), False, 0.0, "out of range", False), (~x.between(low, high), True, 0.7, "outside the city", True))


def phone(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    good = (F.char_length(digits) == 10) | ((F.char_length(digits) == 11) & digits.startswith("1"))
    return rule("phone", (~good, False, 0.5, "not a phone number", True))


def url(c: Column, field: str = "website") -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return rule(field, (~s.rlike(URL), False, 0.0, "not a URL", False), (~F.lower(s).startswith("https"), True, 0.8, None, False))


def within(c: Column, field: str, low: float, high: float) -> Column:
    x = c.cast("string").try_cast("double")
    return rule(field, (x.isNull(), False, 0.0, "not a number", False), (~x.between(low, high), False, 0.0, "out of range", False))


def start_time(c: Column, now: Column) -> Column:
    days = F.floor((seconds(c) - seconds(now)) / 86400)
    return rule("start_time", (c.isNull(), False, 0.0, "not a time", False), (days < -30, True, 0.6, "long past", True), (days > 365, True, 0.7, "far ahead", True))


def duration(start: Column, end: Column) -> Column:
    hours = (seconds(end) - seconds(start)) / 3600
    return rule("duration", (hours < 0, False, 0.0, "ends before it starts", False), (hours > 24, True, 0.7, "over a day", True))


def seconds(c: Column) -> Column:
    """Epoch seconds of a time, as UTC."""
    return F.unix_timestamp(c.cast("timestamp"))


def scores(json: Column, field: str = "psychographic_relevance") -> Column:
    """0.9 for each unknown key, 0.7 for each value out of 0..1, 0.5 for each that is no number, multiplied; valid above 0.3."""
    parsed = F.from_json(json, "map<string,string>")

    def step(acc: Column, e: Column) -> Column:
        x = e["value"].try_cast("double")
        return acc * F.when(e["key"].isin(DIMENSIONS), 1.0).otherwise(0.9) * F.when(x.isNull(), 0.5).when(~x.between(0, 1), 0.7).otherwise(1.0)

    points = F.coalesce(F.aggregate(F.map_entries(parsed), F.lit(1.0), step), F.lit(0.0))
    valid = points > 0.3
    return F.struct(valid.alias("is_valid"), F.lit(field).alias("field"), F.when(~valid, "bad scores").alias("error"), F.lit(None).cast("string").alias("warning"), points.alias("score"))


def model_version(c: Column) -> Column:
    return rule("model_version", (~F.coalesce(c, F.lit("")).rlike(VERSION), False, 0.7, "not a version", True))


def feature_list(json: Column) -> Column:
    items = F.from_json(json, "array<string>")
    quoted = F.regexp_like(json, F.lit(r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'))
    return rule("features", (items.isNull(), False, 0.0, "not a list", False), (F.size(items) == 0, False, 0.3, "empty", False), (~quoted, False, 0.6, "not all strings", False))


def results(*rules: Column) -> Column:
    """One array of the rules that were asked for (null where a rule doesn't apply)."""
    return F.array_compact(F.array(*rules))


def optional(c: Column, made: Column) -> Column:
    return F.when(c.isNotNull(), made)


def venue_rules(c=F.col) -> Column:
    need = [required(c(k), k) for k in ("name", "category", "provider")]
    return results(*need, name(c("name")), optional(c("description"), description(c("description"))), category(c("category"), VENUE_CATEGORIES), coordinate(c("lat"), "lat"), coordinate(c("lng"), "lng"), optional(c("phone"), phone(c("phone"))), optional(c("website"), url(c("website"))), optional(c("avg_rating"), within(c("avg_rating"), "avg_rating", 0, 5)), optional(c("psychographic_relevance"), scores(c("psychographic_relevance"))))


def event_rules(now: Column, c=F.col) -> Column:
    need = [required(c(k), k) for k in ("name", "category", "start_time")]
    return results(*need, name(c("name")), optional(c("description"), description(c("description"))), category(c("category"), EVENT_CATEGORIES), start_time(c("start_time"), now), optional(c("end_time"), duration(c("start_time"), c("end_time"))), optional(c("psychographic_relevance"), scores(c("psychographic_relevance"))))


def prediction_rules(c=F.col) -> Column:
    need = [required(c(k), k) for k in ("venue_id", "prediction_type", "prediction_value")]
    return results(*need, within(c("prediction_value"), "prediction_value", 0, 1), within(c("confidence_score"), "confidence_score", 0, 1), optional(c("model_version"), model_version(c("model_version"))), optional(c("features_used"), feature_list(c("features_used"))))


def generic_rules(c=F.col) -> Column:
    return results(optional(c("name"), name(c("name"))), rule("record", score=0.8))


def verdict(rules: Column) -> Column:
    """(is_valid, score): whether all rules hold, and their mean score. Validation flags and never drops."""

    def made(each: Column) -> Column:
        total = F.aggregate(each, F.lit(0.0), lambda a, r: a + r["score"])
        return F.struct(F.forall(each, lambda r: r["is_valid"]).alias("is_valid"), (total / F.greatest(F.size(each), F.lit(1))).alias("score"))

    return F.element_at(F.transform(F.array(rules), made), 1)  # the rules stand in the plan once


def dataset_quality(df: DataFrame, columns: list[str], rules: Column) -> DataFrame:
    """One row: records, completeness (present cells), accuracy (mean score), consistency (mean over
    provider and category of 1 - (distinct - 1) / non-null; 1 below two records) and their 0.3/0.4/0.3 mean."""
    present = [F.count(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1)) for c in columns]
    each = [1 - F.try_divide(F.greatest(F.count_distinct(c) - 1, F.lit(0)), F.count(c)) for c in ("provider", "category")]
    known = reduce(lambda a, b: a + b, [F.when(F.count(c) > 0, 1).otherwise(0) for c in ("provider", "category")])
    even = F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in each]), known)
    one = df.withColumn("__score", verdict(rules)["score"]).agg(
        F.count("*").alias("records"), F.try_divide(reduce(lambda a, b: a + b, present), F.count("*") * len(columns)).alias("completeness"),
        F.avg("__score").alias("accuracy"), F.when(F.count("*") < 2, 1.0).otherwise(F.coalesce(even, F.lit(1.0))).alias("consistency"),
    )
    return one.withColumn("quality", 0.3 * F.col("completeness").cast("double") + 0.4 * F.col("accuracy") + 0.3 * F.col("consistency"))
