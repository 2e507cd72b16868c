"""Registered queries over the bridged tables, each beside SQL for the same rows.

Filters and columns reach the Parquet scans; sides are reduced to a row per key before joins;
windows that would gather everything in one task are avoided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitas.functions import quality as q
from civitas.functions import scoring as sc
from civitas.functions import text as tx
from civitas.operators import geo, joins, merge, model, ranges
from civitas.operators.quantile import exact_quantile
from civitas.sources import bridge as b

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, bridged: bool = True):
    """Register a function under its name, with SQL over the bridged tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {b.SQL} {sql}" if bridged else sql
        return f

    return add


def r4(c, name: str):
    return sc.rounded(F.col(c) if isinstance(c, str) else c, 4).alias(name)


BOX = geo.Bounds()
_IN = f"lat BETWEEN {BOX.south}::DOUBLE AND {BOX.north}::DOUBLE AND lng BETWEEN {BOX.west}::DOUBLE AND {BOX.east}::DOUBLE"


# Reads


@query("SELECT venue_id, name, category, round(lat, 4) AS lat, avg_rating FROM venues WHERE category = 'bar' AND lat IS NOT NULL AND lng IS NOT NULL AND avg_rating >= 3")
def venues_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).where("category = 'bar' AND lat IS NOT NULL AND lng IS NOT NULL AND avg_rating >= 3")
    return v.select("venue_id", "name", "category", r4("lat", "lat"), "avg_rating")


@query("SELECT venue_id, round(lat, 4) AS lat, round(lng, 4) AS lng FROM venues WHERE lat BETWEEN 39.0 AND 39.2 AND lng BETWEEN -94.7 AND -94.5")
def venues_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.venues(spark, sf_dir).where(geo.in_bounds(geo.Bounds(39.0, 39.2, -94.7, -94.5))).select("venue_id", r4("lat", "lat"), r4("lng", "lng"))


@query("SELECT venue_id, name, category FROM venues WHERE venue_id = 42")
def venue_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.venues(spark, sf_dir).where("venue_id = 42").select("venue_id", "name", "category")


@query("SELECT event_id, start_time, e.category, v.name AS venue_name FROM ev e LEFT JOIN venues v USING (venue_id) WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time <= TIMESTAMP '2024-01-12'")
def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events(spark, sf_dir).where("start_time >= TIMESTAMP_NTZ '2024-01-05' AND start_time <= TIMESTAMP_NTZ '2024-01-12'").select("event_id", "start_time", "category", "venue_id")
    return e.join(b.venues(spark, sf_dir).select("venue_id", F.col("name").alias("venue_name")), "venue_id", "left").drop("venue_id")


@query("SELECT event_id, start_time FROM ev ORDER BY start_time DESC, event_id LIMIT 100")
def events_limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir).select("event_id", "start_time").orderBy(F.desc("start_time"), "event_id").limit(100)


@query("SELECT v.venue_id, prediction_id, coalesce(prediction_value, 0) AS prediction_value FROM venues v LEFT JOIN predictions p ON v.venue_id = p.venue_id AND prediction_type = 'attendance'")
def venues_with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).where("prediction_type = 'attendance'").select("venue_id", "prediction_id", "prediction_value")
    return b.venues(spark, sf_dir).select("venue_id").join(p, "venue_id", "left").withColumn("prediction_value", F.coalesce("prediction_value", F.lit(0.0)))


@query("SELECT prediction_id, p.venue_id, name, prediction_value FROM predictions p LEFT JOIN venues v USING (venue_id) WHERE p.venue_id IN (1, 7, 44, 101)")
def predictions_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).where(F.col("venue_id").isin(1, 7, 44, 101)).select("prediction_id", "venue_id", "prediction_value")
    return p.join(b.venues(spark, sf_dir).select("venue_id", "name"), "venue_id", "left")


_BEST = "SELECT venue_id, prediction_id, prediction_value FROM predictions QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY prediction_value DESC, prediction_id) = 1"


@query(_BEST)
def best_prediction_per_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).select("venue_id", "prediction_id", "prediction_value")
    return joins.first_per(p, ["venue_id"], [F.desc("prediction_value"), F.col("prediction_id")])


@query("SELECT count(*) FILTER (start_time >= now - INTERVAL 48 HOUR AND start_time <= now) AS last_48h, count(*) FILTER (start_time >= now AND start_time <= now + INTERVAL 7 DAY) AS next_7d, count(*) AS total FROM ev, as_of")
def recent_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, at = b.as_of(), F.col("start_time")
    return b.events(spark, sf_dir).agg(
        F.count_if((at >= now - F.expr("INTERVAL 48 HOURS")) & (at <= now)).alias("last_48h"), F.count_if((at >= now) & (at <= now + F.expr("INTERVAL 7 DAYS"))).alias("next_7d"), F.count("*").alias("total")
    )


# Joins


@query("SELECT o.c_custkey AS asked, min(v.venue_id) AS venue_id FROM customer o JOIN venues v ON lower(upper(o.c_name)) = lower(v.name) GROUP BY 1")
def name_lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asked"), F.lower(F.upper("c_name")).alias("low"))
    known = b.venues(spark, sf_dir).groupBy(F.lower("name").alias("low")).agg(F.min("venue_id").alias("venue_id"))
    return asked.join(known, "low").select("asked", "venue_id")


@query("""SELECT n_name AS query, r_regionkey AS place_id, CASE WHEN lower(n_name) = lower(r_name) THEN 'exact' ELSE 'contained' END AS how FROM (
SELECT n_name, r_regionkey, r_name, row_number() OVER (PARTITION BY n_name ORDER BY lower(n_name) <> lower(r_name), r_regionkey) AS place FROM
(SELECT n_name || ' ' || r_name || ' Hall' AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT upper(r_name) FROM region) a JOIN region ON contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name))) WHERE place = 1""", bridged=False)
def name_lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    asked = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(" ", "n_name", "r_name", F.lit("Hall")).alias("query"))
    asked = asked.unionByName(region.select(F.upper("r_name").alias("query")))
    return joins.match_names(asked, region.select(F.col("r_regionkey").alias("place_id"), F.col("r_name").alias("name")))


def _sql_clean(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), '\\b({'|'.join(joins.COMMON)})\\b', '', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT query, min_by(venue_id, (rank, venue_id)) AS place_id, CASE min(rank) WHEN 0 THEN 'exact' ELSE 'found' END AS how FROM (SELECT query, venue_id, CASE WHEN lower(query) = lower(name) THEN 0 ELSE 1 END AS rank
FROM (SELECT DISTINCT CASE venue_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN 'KC ' || name || ' Theatre' WHEN 2 THEN replace(name, '#', '-') || ' (Kansas City)' ELSE 'Nothing ' || venue_id END AS query FROM venues) a
JOIN (SELECT name, min(venue_id) AS venue_id FROM venues GROUP BY 1) v ON contains(lower(query), lower(name)) OR contains(lower(name), lower(query)) OR ({_sql_clean('query')} <> '' AND {_sql_clean('name')} <> '' AND (contains({_sql_clean('query')}, {_sql_clean('name')}) OR contains({_sql_clean('name')}, {_sql_clean('query')})))) GROUP BY query""")
def name_lookup_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every venue's name as someone else writes it, looked up among all venues."""
    v, k = b.venues(spark, sf_dir), F.col("venue_id") % 4
    form = F.when(k == 0, F.upper("name")).when(k == 1, F.concat(F.lit("KC "), "name", F.lit(" Theatre"))).when(k == 2, F.concat(F.replace("name", F.lit("#"), F.lit("-")), F.lit(" (Kansas City)"))).otherwise(F.concat(F.lit("Nothing "), F.col("venue_id").cast("string")))
    found = joins.match_names(v.select(form.alias("query")), v.select(F.col("venue_id").alias("place_id"), "name"))
    return found.select("query", "place_id", F.when(F.col("how") == "exact", "exact").otherwise("found").alias("how"))


_NEAREST = """SELECT v.venue_id, d.demo_id, d.median_income, round(abs(v.lat - d.lat) + abs(v.lng - d.lng), 4) AS distance FROM venues v
LEFT JOIN demographics d ON abs(v.lat - d.lat) < 0.01::DOUBLE AND abs(v.lng - d.lng) < 0.01::DOUBLE
QUALIFY row_number() OVER (PARTITION BY v.venue_id ORDER BY round(abs(v.lat - d.lat) + abs(v.lng - d.lng), 9) NULLS LAST, d.demo_id NULLS LAST) = 1"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.demographics(spark, sf_dir).select("demo_id", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), "median_income")
    return joins.nearest_in_box(b.venues(spark, sf_dir).select("venue_id", "lat", "lng"), d, "venue_id", "demo_id")


@query(_NEAREST)
def nearest_demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("venue_id", "demo_id", "median_income", r4("distance", "distance"))


@query("SELECT e.event_id, count(w.weather_id) AS forecasts, round(sum(w.temperature_f) * 100)::BIGINT / (100 * nullif(count(w.weather_id), 0)) AS mean_temperature FROM ev e LEFT JOIN weather w ON abs(epoch(e.start_time) - epoch(w.timestamp)) < 3600 WHERE e.start_time >= TIMESTAMP '2024-01-15' GROUP BY 1")
def master_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = b.events(spark, sf_dir).where(F.col("start_time") >= b.as_of()).select("event_id", micro("start_time").alias("at"))
    w = b.weather(spark, sf_dir).select(micro("timestamp").alias("w_at"), F.round(F.col("temperature_f") * 1_000_000).cast("long").alias("millionths"))
    found = ranges.totals_within(e, w, "at", "w_at", 3_600_000_000, {"millionths": "millionths"})
    cents = F.round(F.col("millionths") / 10_000).cast("long")  # whole cents: no order of summing shows in the mean
    return found.select("event_id", F.col("matches").alias("forecasts"), F.try_divide(cents, 100 * F.col("matches")).alias("mean_temperature"))


def _micro(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


@query("SELECT event_id FROM ev, as_of WHERE start_time < now - INTERVAL 10 DAY AND venue_id NOT IN (SELECT venue_id FROM venues WHERE lat IS NOT NULL)")
def unlocated_old_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = b.events(spark, sf_dir).where((F.col("start_time") < b.as_of() - F.expr("INTERVAL 10 DAYS")) & F.col("venue_id").isNotNull())
    return old.join(b.venues(spark, sf_dir).where("lat IS NOT NULL").select("venue_id"), "venue_id", "left_anti").select("event_id")


# Views


@query(f"""SELECT v.venue_id, v.category, n.median_income, round(p.prediction_value, 4) AS prediction_value, coalesce(u.n, 0) AS upcoming_events_count FROM venues v LEFT JOIN ({_NEAREST}) n USING (venue_id)
LEFT JOIN (SELECT * FROM predictions WHERE prediction_type = 'psychographic_match' QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY generated_at DESC, prediction_id) = 1) p USING (venue_id)
LEFT JOIN (SELECT venue_id, count(DISTINCT event_id) AS n FROM ev, as_of WHERE start_time > now GROUP BY 1) u USING (venue_id)""")
def master_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = b.predictions(spark, sf_dir).where("prediction_type = 'psychographic_match'").select("venue_id", "prediction_id", "generated_at", "prediction_value")
    latest = joins.first_per(matches, ["venue_id"], [F.desc("generated_at"), F.col("prediction_id")]).select("venue_id", r4("prediction_value", "prediction_value"))
    coming = b.events(spark, sf_dir).where(F.col("start_time") > b.as_of()).groupBy("venue_id").agg(F.count_distinct("event_id").alias("n"))
    v = b.venues(spark, sf_dir).select("venue_id", "category")
    out = v.join(_nearest(spark, sf_dir).select("venue_id", "median_income"), "venue_id", "left").join(latest, "venue_id", "left").join(coming, "venue_id", "left")
    return out.select("venue_id", "category", "median_income", "prediction_value", F.coalesce("n", F.lit(0)).alias("upcoming_events_count"))


_FIT = "p.career_driven_score * 0.35::DOUBLE + p.competent_score * 0.30::DOUBLE + p.fun_score * 0.35::DOUBLE"


@query(f"SELECT prediction_id, v.venue_id, name, round({_FIT}, 4) AS fit FROM venues v JOIN predictions p USING (venue_id) WHERE prediction_type = 'psychographic_match' AND prediction_value >= 0.6 AND confidence_score >= 0.7")
def high_value_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).where("prediction_type = 'psychographic_match' AND prediction_value >= 0.6 AND confidence_score >= 0.7")
    p = p.select("prediction_id", "venue_id", r4(sc.fit(*(F.col(c) for c in ("career_driven_score", "competent_score", "fun_score"))), "fit"))
    return p.join(b.venues(spark, sf_dir).select("venue_id", "name"), "venue_id")


@query("""SELECT 'venues' AS table_name, count(*) AS total_records, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS with_location, count(avg_rating) AS with_key_attribute, round(avg(quality), 4) AS avg_quality FROM venues
UNION ALL SELECT 'events', count(*), 0, count(start_time), 0 FROM ev""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).agg(F.count("*").alias("total_records"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("with_location"), F.count("avg_rating").alias("with_key_attribute"), F.round(F.avg("quality"), 4).alias("avg_quality"))
    e = b.events(spark, sf_dir).agg(F.count("*").alias("total_records"), F.lit(0).cast("long").alias("with_location"), F.count("start_time").alias("with_key_attribute"), F.lit(0.0).alias("avg_quality"))
    return v.select(F.lit("venues").alias("table_name"), "*").union(e.select(F.lit("events").alias("table_name"), "*"))


@query("""SELECT source_name, max(ran_at) FILTER (success) AS last_success, count(*) FILTER (NOT success) AS errors,
CASE WHEN max(ran_at) FILTER (success) IS NULL THEN 'Never Run' WHEN max(ran_at) FILTER (success) < max(now) - INTERVAL 24 HOUR THEN 'Stale' WHEN count(*) FILTER (NOT success) > 3 * count(*) FILTER (success) THEN 'Failing' ELSE 'Healthy' END AS status FROM runs, as_of GROUP BY source_name""")
def collection_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, good, bad = F.max(F.when(F.col("success"), F.col("ran_at"))), F.count_if("success"), F.count_if(~F.col("success"))
    status = F.when(last.isNull(), "Never Run").when(last < b.as_of() - F.expr("INTERVAL 24 HOURS"), "Stale").when(bad > 3 * good, "Failing").otherwise("Healthy")
    return b.runs(spark, sf_dir).groupBy("source_name").agg(last.alias("last_success"), bad.alias("errors"), status.alias("status"))


# Aggregates


@query("SELECT (SELECT count(*) FROM venues) AS venues, (SELECT count(lat) FROM venues) AS located, (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM predictions) AS predictions, round((SELECT count(lat) FROM venues) / greatest((SELECT count(*) FROM venues), 1), 4) AS completeness")
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).agg(F.count("*").alias("venues"), F.count("lat").alias("located"))
    e, p = (t.agg(F.count("*").alias(n)) for t, n in ((b.events(spark, sf_dir), "events"), (b.predictions(spark, sf_dir), "predictions")))
    one = v.join(F.broadcast(e)).join(F.broadcast(p))  # one row each
    return one.withColumn("completeness", F.round(F.col("located") / F.greatest("venues", F.lit(1)), 4))


@query("SELECT prediction_type, count(*) AS n, round(avg(prediction_value), 4) AS mean_value, round(avg(confidence_score), 4) AS mean_confidence, max(generated_at) AS latest FROM predictions GROUP BY 1")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.predictions(spark, sf_dir).groupBy("prediction_type").agg(F.count("*").alias("n"), F.round(F.avg("prediction_value"), 4).alias("mean_value"), F.round(F.avg("confidence_score"), 4).alias("mean_confidence"), F.max("generated_at").alias("latest"))


@query("""SELECT venue_id, prediction_id, round(prediction_value, 4) AS prediction_value FROM predictions WHERE prediction_value >= (SELECT quantile_cont(prediction_value, 0.8) FROM predictions)""")
def top20_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).select("venue_id", "prediction_id", "prediction_value")
    return p.where(F.col("prediction_value") >= F.lit(exact_quantile(p, "prediction_value", 0.8))).select("venue_id", "prediction_id", r4("prediction_value", "prediction_value"))


@query("SELECT coalesce(round(avg(lat), 4), 39.0997) AS lat, coalesce(round(avg(lng), 4), -94.5786) AS lng FROM (SELECT lat, lng FROM venues UNION ALL SELECT lat, lng FROM demographics)")
def map_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = b.venues(spark, sf_dir).select("lat", "lng").unionByName(b.demographics(spark, sf_dir).select("lat", "lng"))
    return geo.centre(both).select(r4("lat", "lat"), r4("lng", "lng"))


@query("SELECT venue_id, category, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY venue_id, category ORDER BY event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir).groupBy("venue_id", "category").agg(F.min("event_id").alias("event_id"))


# Quality


def _checked(df: DataFrame, key: str, rule) -> DataFrame:
    return df.select(key, rule.alias("r")).select(key, "r.is_valid", F.round("r.score", 4).alias("score"))


@query("""SELECT doc_id, n >= 2 AND n <= 200 AND a AS is_valid, CASE WHEN n < 2 THEN 0.2 WHEN n > 200 THEN 0.3 WHEN NOT a THEN 0.4 WHEN n < 5 THEN 0.7 WHEN n > 100 THEN 0.8 ELSE 1.0 END::DOUBLE AS score
FROM (SELECT doc_id, length(s) AS n, regexp_matches(s, '[a-zA-Z]') AS a FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS s FROM documents))""", bridged=False)
def validate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"))
    return _checked(d, "doc_id", q.name(F.col("name")))


@query("SELECT venue_id, lat IS NOT NULL AS is_valid, CASE WHEN lat IS NULL THEN 0 WHEN lat BETWEEN 38.5 AND 39.5 THEN 1 ELSE 0.7 END::DOUBLE AS score FROM venues")
def validate_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(b.venues(spark, sf_dir), "venue_id", q.coordinate(F.col("lat"), "lat"))


_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"


@query(f"SELECT doc_id, length({_DIGITS}) = 10 OR (length({_DIGITS}) = 11 AND {_DIGITS}[1] = '1') AS is_valid, CASE WHEN length({_DIGITS}) = 10 OR (length({_DIGITS}) = 11 AND {_DIGITS}[1] = '1') THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM (SELECT doc_id, regexp_extract(text, '\\+?[0-9 ()-]{{10,}}') AS phone FROM documents)", bridged=False)
def validate_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"\+?[0-9 ()-]{10,}", 0).alias("phone"))
    return _checked(d, "doc_id", q.phone(F.col("phone")))


_URL = q.URL.replace("'", "''")


@query(f"SELECT page_id, regexp_matches(trim(url), '{_URL}') AS is_valid, CASE WHEN NOT regexp_matches(trim(url), '{_URL}') THEN 0 WHEN NOT starts_with(lower(trim(url)), 'https') THEN 0.8 ELSE 1 END::DOUBLE AS score FROM pages", bridged=False)
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(b.table(spark, sf_dir, "pages"), "page_id", q.url(F.col("url")))


@query("""SELECT event_id, s > 0.3 AS is_valid, s AS score FROM (SELECT event_id, round(0.9 * CASE WHEN k BETWEEN 0 AND 1 THEN 1 ELSE 0.7 END, 4)::DOUBLE AS s FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM ev))""")
def validate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(b.events(spark, sf_dir), "event_id", q.scores(F.col("props")))


@query("""SELECT prediction_id, s AND p AS is_valid, round((3 + CASE WHEN p THEN 1 ELSE 0 END + CASE WHEN s THEN 1 ELSE 0 END) / 5, 4) AS score FROM (SELECT prediction_id, confidence_score BETWEEN 0 AND 1 AS s, prediction_value BETWEEN 0 AND 1 AS p FROM predictions)""")
def validate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = b.predictions(spark, sf_dir).withColumns({"model_version": none, "features_used": none})
    return _checked(p, "prediction_id", q.verdict(q.prediction_rules()))


@query("""SELECT records, round(completeness, 4) AS completeness, round(consistency, 4) AS consistency FROM (SELECT count(*) AS records, (count(name) + count(category) + count(lat) + count(lng) + count(avg_rating)) / (5.0 * count(*)) AS completeness,
((1 - (count(DISTINCT provider) - 1) / count(provider)) + (1 - (count(DISTINCT category) - 1) / count(category))) / 2 AS consistency FROM venues)""")
def dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir)
    out = q.dataset_quality(v, ["name", "category", "lat", "lng", "avg_rating"], q.results(q.name(F.col("name")), q.category(F.col("category"), q.VENUE_CATEGORIES)))
    return out.select("records", F.round(F.col("completeness").cast("double"), 4).alias("completeness"), F.round(F.col("consistency").cast("double"), 4).alias("consistency"))


# Scores


def _sql_scores(text: str, keywords: dict, weight: int) -> str:
    each = lambda words: " + ".join(f"contains({text}, '{w}')::INT" for w in words)
    return ", ".join(f"round(least(({each(words)}) * {weight}::DOUBLE / {len(words)}, 1), 4) AS {k}" for k, words in keywords.items())


@query(f"SELECT doc_id, {_sql_scores('low', sc.EVENT_KEYWORDS, 2)} FROM (SELECT doc_id, lower(text) AS low FROM documents)", bridged=False)
def score_event_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sc.keyword_scores(F.col("text"), sc.EVENT_KEYWORDS, 2.0)
    return b.table(spark, sf_dir, "documents").select("doc_id", *(r4(c, k) for k, c in scores.items()))


@query(f"SELECT venue_id, {_sql_scores('low', sc.VENUE_KEYWORDS, 1)} FROM (SELECT venue_id, lower(name || ' ' || category) AS low FROM venues)")
def score_venue_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sc.keyword_scores(F.concat_ws(" ", "name", "category"), sc.VENUE_KEYWORDS)
    return b.venues(spark, sf_dir).select("venue_id", *(r4(c, k) for k, c in scores.items()))


_BOOST = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sc.LABEL_BOOST.items()) + " ELSE 0 END"


@query(f"SELECT venue_id, CASE WHEN round(least(greatest((avg_rating - 1) / 4 + {_BOOST} + CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 0.1 ELSE -0.2 END::DOUBLE, 0), 1), 9) > 0.5 AND avg_rating IS NOT NULL THEN 1 ELSE 0 END AS label FROM venues")
def label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.venues(spark, sf_dir).select("venue_id", sc.label(*(F.col(c) for c in ("avg_rating", "category", "lat", "lng"))).alias("label"))


_MATRIX = """SELECT v.venue_id, round(coalesce(lat, 0), 4) AS lat, coalesce(avg_rating, 3.0::DOUBLE) AS avg_rating, code AS category_code, coalesce(n, 0) AS event_count, (lat IS NOT NULL AND lng IS NOT NULL)::INT AS has_location FROM venues v
JOIN (SELECT category, (dense_rank() OVER (ORDER BY category) - 1)::INT AS code FROM (SELECT DISTINCT category FROM venues)) USING (category)
LEFT JOIN (SELECT venue_id, count(*) AS n FROM ev, as_of WHERE start_time >= now - INTERVAL 30 DAY AND start_time <= now GROUP BY 1) e USING (venue_id)"""


@query(_MATRIX)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.feature_matrix(b.venues(spark, sf_dir), b.events(spark, sf_dir), b.as_of())
    return m.select("venue_id", r4("lat", "lat"), "avg_rating", "category_code", "event_count", "has_location")


@query(f"SELECT venue_id, round(1 / (1 + exp(-(avg_rating + category_code + event_count + has_location) / 10)), 4) AS score FROM ({_MATRIX})")
def mock_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_matrix(spark, sf_dir).select("venue_id", r4(model.sigmoid_score(*(F.col(c) for c in ("avg_rating", "category_code", "event_count", "has_location"))), "score"))


_FACTOR = "CASE CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(sc.EVENT_FACTOR)) + " ELSE 'x' END " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sc.EVENT_FACTOR.items()) + " ELSE 1 END"
_HOUR = "CASE WHEN hour(start_time) BETWEEN 18 AND 22 THEN 1.2 WHEN hour(start_time) BETWEEN 12 AND 17 THEN 1.0 WHEN hour(start_time) >= 22 OR hour(start_time) <= 6 THEN 0.8 ELSE 0.7 END::DOUBLE"


@query(f"SELECT event_id, round(least({_FACTOR} * {_HOUR}, 2), 4) AS adjustment, CASE WHEN p.prediction_value IS NOT NULL THEN round(least(p.prediction_value * least({_FACTOR} * {_HOUR}, 2), 1), 4) END AS prediction FROM ev LEFT JOIN ({_BEST}) p USING (venue_id)")
def event_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = sc.literal_map(dict(enumerate(sc.EVENT_FACTOR)))
    e = b.events(spark, sf_dir).withColumn("kind", F.try_element_at(kinds, (F.col("event_id") % 8).cast("int")))
    e = e.select("event_id", "venue_id", sc.event_adjustment(F.col("kind"), F.col("start_time")).alias("a"))
    best = best_prediction_per_venue(spark, sf_dir)
    # a venue without a prediction gives its events none
    moved = F.when(F.col("prediction_value").isNotNull(), F.least(F.col("prediction_value") * F.col("a"), F.lit(1.0)))
    return e.join(best, "venue_id", "left").select("event_id", r4("a", "adjustment"), F.round(moved, 4).alias("prediction"))


@query("SELECT venue_id, CASE WHEN category IN ('nightclub', 'bar', 'restaurant') THEN 'high_density' WHEN category IN ('theater', 'music_venue', 'sports_venue') THEN 'medium_density' ELSE 'low_density' END AS density FROM venues")
def area_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.venues(spark, sf_dir).select("venue_id", sc.area_density(F.col("category")).alias("density"))



@query("SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'recreation' WHEN p_partkey % 6 = 2 THEN 'nightclub' WHEN p_partkey % 6 = 3 THEN 'restaurant' WHEN p_partkey % 6 = 4 THEN 'sports_venue' ELSE 'local_venue' END AS category FROM part", bridged=False)
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [["point_of_interest", "spa", "bar"], ["gym"], ["x", "night_club", "bar"], ["cafe", "museum"], ["stadium"], ["x", "y"]]
    types = F.element_at(F.array(*(F.array(*map(F.lit, t)) for t in lists)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return b.table(spark, sf_dir, "part").select("p_partkey", sc.type_category(types).alias("category"))


# Geography


_HEAT = f"""grid AS (SELECT i AS cell, {BOX.south}::DOUBLE + (i // 20) * {(BOX.north - BOX.south) / 20!r}::DOUBLE AS g_lat, {BOX.west}::DOUBLE + (i % 20) * {(BOX.east - BOX.west) / 20!r}::DOUBLE AS g_lng FROM range(400) t(i)),
pairs AS (SELECT cell, g_lat, g_lng, 1 / (1 + 100 * sqrt(pow(g_lat - lat, 2) + pow(g_lng - lng, 2))) AS w, 0.5 + 0.1 * (coalesce(avg_rating, 3) - 3) AS x FROM grid, venues WHERE lat IS NOT NULL AND lng IS NOT NULL),
heat AS (SELECT cell, g_lat, g_lng, least(sum(w * x) / sum(w), 1) AS value FROM pairs GROUP BY ALL)"""


@query(f", {_HEAT} SELECT cell, round(g_lat, 4) AS lat, round(g_lng, 4) AS lng, round(value, 4) AS value FROM heat WHERE value > 0.1")
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = geo.heat(geo.grid(spark), b.venues(spark, sf_dir))
    return cells.select("cell", r4("g_lat", "lat"), r4("g_lng", "lng"), r4("value", "value"))


_UNION = f", {_HEAT} SELECT 'venue' AS kind, v.venue_id AS id, round(prediction_value, 4) AS value FROM venues v JOIN ({_BEST}) p USING (venue_id) WHERE {_IN} UNION ALL SELECT 'grid', cell, round(value, 4) FROM heat WHERE value > 0.1"


@query(_UNION)
def heatmap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = b.venues(spark, sf_dir).where(geo.in_bounds(BOX)).select("venue_id")
    v = inside.join(best_prediction_per_venue(spark, sf_dir), "venue_id").select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"), r4("prediction_value", "value"))
    return v.unionByName(heatmap_grid(spark, sf_dir).select(F.lit("grid").alias("kind"), F.col("cell").alias("id"), "value"))


@query(f"SELECT round({BOX.south}::DOUBLE + i * 5 / 111.0::DOUBLE, 4) AS lat, round({BOX.west}::DOUBLE + j * 5 / 85.0::DOUBLE, 4) AS lng FROM range(9) a(i), range(7) c(j)", bridged=False)
def search_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.search_grid(spark, BOX).select(r4("s_lat", "lat"), r4("s_lng", "lng"))


@query("SELECT prediction_id, round(greatest(prediction_value / (SELECT max(prediction_value) FROM predictions), 0.1), 4) AS intensity FROM predictions WHERE prediction_value > 0")
def heat_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.intensity(b.predictions(spark, sf_dir).select("prediction_id", "prediction_value"), "prediction_value").select("prediction_id", r4("intensity", "intensity"))


_S = "coalesce(avg_rating, 3) / 5"


@query(f"SELECT venue_id, CASE WHEN {_S} >= 0.8 THEN 12 WHEN {_S} >= 0.6 THEN 10 WHEN {_S} >= 0.4 THEN 8 WHEN {_S} >= 0.2 THEN 6 ELSE 4 END AS radius, CASE WHEN {_S} >= 0.8 THEN '#d73027' WHEN {_S} >= 0.6 THEN '#fc8d59' WHEN {_S} >= 0.4 THEN '#fee08b' WHEN {_S} >= 0.2 THEN '#e0f3f8' ELSE '#91bfdb' END AS colour FROM venues")
def marker_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sc.marker(F.coalesce("avg_rating", F.lit(3.0)) / 5)
    return b.venues(spark, sf_dir).select("venue_id", m.alias("m")).select("venue_id", "m.radius", "m.colour")


@query("SELECT 'Feature' AS type, round(lng, 4) AS x, round(lat, 4) AS y, venue_id, name FROM venues WHERE lat IS NOT NULL AND lng IS NOT NULL")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = geo.features(b.venues(spark, sf_dir).select("venue_id", "name", "lat", "lng"))
    at = F.col("feature.geometry.coordinates")
    return f.select("feature.type", r4(at[0], "x"), r4(at[1], "y"), "feature.properties.venue_id", "feature.properties.name")


# Merges


@query("""SELECT coalesce(t.venue_id, s.venue_id) AS venue_id, coalesce(s.name, t.name) AS name, CASE WHEN s.venue_id IS NOT NULL THEN s.quality ELSE t.quality END AS quality FROM (SELECT venue_id, name, quality FROM venues WHERE venue_id % 3 <> 0) t
FULL JOIN (SELECT venue_id, upper(name) AS name, 1.0::DOUBLE AS quality FROM venues WHERE venue_id % 2 = 0) s ON t.venue_id = s.venue_id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).select("venue_id", "name", "quality")
    new = v.where("venue_id % 2 = 0").select("venue_id", F.upper("name").alias("name"), F.lit(1.0).alias("quality"))
    return merge.upsert(v.where("venue_id % 3 <> 0"), new, ["venue_id"])


@query("SELECT source_name, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS error_count, round(avg(duration) FILTER (success), 3) AS avg_duration, sum(records) FILTER (success)::BIGINT AS total_records FROM runs GROUP BY 1")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.run_status(b.runs(spark, sf_dir)).select("source_name", "success_count", "error_count", F.round("avg_duration", 3).alias("avg_duration"), "total_records")


@query("SELECT prediction_id, generated_at FROM predictions WHERE generated_at >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.retain(b.predictions(spark, sf_dir).select("prediction_id", "generated_at"), "generated_at", F.lit("1997-01-01").cast("timestamp_ntz"), 365)


# Text


def _sql_strip(html: str) -> str:
    for tag in tx.DROPPED:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return f"substring(trim(regexp_replace(regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 1, 15000)"


@query(f"SELECT page_id, {_sql_strip('html')} AS text, length(html) >= 500 AS acceptable FROM pages", bridged=False)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"), tx.acceptable(F.col("html")).alias("acceptable"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '^(https?://[^/]+)', 1) || '/events' AS link FROM pages", bridged=False)
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"), tx.absolute_url(F.lit("/events"), F.col("url")).alias("link"))


@query("SELECT event_id, 't' || event_id AS title, event_id % 3 AS form FROM ev")
def json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    forms = [("```json\n[{\"title\": \"", "\", \"date\": \"2025-12-15\"}]\n```"), ("Here: [{\"title\": \"", "\",},]"), ("{\"events\": [{\"title\": \"", "\"}]}")]
    answer = F.element_at(F.array(*(F.concat(F.lit(a), title, F.lit(z)) for a, z in forms)), (F.col("event_id") % 3 + 1).cast("int"))
    found = b.events(spark, sf_dir).select("event_id", F.explode(tx.parse_events(answer)).alias("e"))
    return found.select("event_id", "e.title", (F.col("event_id") % 3).alias("form"))


@query("SELECT event_id, date_trunc('minute', start_time) AS parsed FROM ev")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, kind = F.col("start_time"), F.col("event_id") % 4
    day = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd")).when(kind == 1, F.date_format(at, "M/d/yyyy")).otherwise(F.date_format(at, "MMMM d, yyyy"))
    time = F.when(kind.isin(0, 2), F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "h:mm a"))
    return b.events(spark, sf_dir).select("event_id", tx.parse_time(day, time).cast("timestamp_ntz").alias("parsed"))


# Windows, streams as batches, models


@query("SELECT date_trunc('hour', start_time) AS start, category, count(*) AS n, round(sum(value), 3) AS value FROM ev GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.streaming.events import windowed_counts

    out = windowed_counts(b.events(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "category", "n", F.round("value", 3).alias("value"))


@query("SELECT venue_id, day, n, n - lag(n) OVER (PARTITION BY venue_id ORDER BY day) AS trend FROM (SELECT venue_id, date_trunc('day', start_time)::DATE AS day, count(*) AS n FROM ev GROUP BY 1, 2)")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = b.events(spark, sf_dir).groupBy("venue_id", F.to_date("start_time").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("trend", F.col("n") - F.lag("n").over(Window.partitionBy("venue_id").orderBy("day")))


def _dated_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with the time of their first event, by which training goes forward."""
    seen = b.events(spark, sf_dir).groupBy("venue_id").agg(F.min("start_time").alias("seen"))
    return b.venues(spark, sf_dir).join(seen, "venue_id", "left")


@query("""SELECT venue_id, seen, CASE WHEN place < n - 5 * (n // 6) THEN 0 ELSE 1 + (place - (n - 5 * (n // 6))) // (n // 6) END::INTEGER AS fold
FROM (SELECT venue_id, seen, row_number() OVER (ORDER BY seen NULLS FIRST, venue_id) - 1 AS place, count(*) OVER () AS n FROM venues LEFT JOIN (SELECT venue_id, min(start_time) AS seen FROM ev GROUP BY 1) USING (venue_id))""")
def training_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.folds(_dated_venues(spark, sf_dir).select("venue_id", "seen"), ["seen", "venue_id"])


@query()
def gbt_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _dated_venues(spark, sf_dir)
    labels = v.select("venue_id", "seen", sc.label(*(F.col(c) for c in ("avg_rating", "category", "lat", "lng"))).alias("label"))
    rows = model.feature_matrix(v, b.events(spark, sf_dir), b.as_of())
    best, _ = model.train(rows.join(labels, "venue_id"), order=["seen", "venue_id"])
    return model.predict(best, rows)
