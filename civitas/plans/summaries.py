"""Registered queries: summaries in full, map layers, enrichment stores, the whole stand-in model, the cache replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.functions import quality as q
from civitas.functions import scoring as sc
from civitas.operators import geo, maps, model, store, summaries
from civitas.plans.queries import _BEST, _BOOST, _HEAT, _MATRIX, _sql_scores, best_prediction_per_venue, query, r4
from civitas.plans.records import _sql_colour, full
from civitas.sources import bridge as b
from civitas.streaming import cache


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of models, one for each brand of parts, trained when the first of its parts was shipped."""
    shipped = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("at"))
    return b.table(spark, sf_dir, "part").join(shipped, "p_partkey").groupBy(F.col("p_brand").alias("version")).agg(F.min("at").cast("timestamp_ntz").alias("trained_at"))


@full("""SELECT (SELECT count(*) FROM vf) AS total_venues, (SELECT count(*) FROM ef) AS total_events, (SELECT count(*) FROM predictions) AS total_predictions, (SELECT count(*) FROM vf WHERE lat IS NOT NULL AND lng IS NOT NULL) AS located_venues,
(SELECT count(*) FROM vf WHERE created_at >= now - INTERVAL 7 DAY) AS recent_venues, (SELECT count(*) FROM ef WHERE start_time >= now - INTERVAL 7 DAY) AS recent_events, (SELECT count(*) FROM demographics) AS demographic_records, (SELECT count(*) FROM weather) AS weather_records, (SELECT count(*) FROM ev WHERE category = 'click') AS traffic_records,
round((SELECT count(*) FROM vf WHERE lat IS NOT NULL AND lng IS NOT NULL) / greatest((SELECT count(*) FROM vf), 1), 4) AS location_completeness, now AS timestamp FROM as_of""")
def data_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events count as made when they start, clicks as visits."""
    events = b.events(spark, sf_dir)
    made = events.select(F.col("start_time").alias("created_at"))
    out = summaries.data_summary(b.venues_full(spark, sf_dir), made, b.predictions(spark, sf_dir), b.demographics(spark, sf_dir), b.weather(spark, sf_dir), events.where("category = 'click'"), b.as_of())
    return out.withColumn("location_completeness", F.round("location_completeness", 4))


@query("""SELECT count(*) AS total_predictions, count(*) FILTER (generated_at > TIMESTAMP '1997-01-02' - INTERVAL 1 DAY) AS recent_predictions, round(avg(coalesce(confidence_score, 0)), 4) AS avg_confidence, round(avg(coalesce(prediction_value, 0)), 4) AS avg_prediction_value, max(generated_at) AS last_updated,
(SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY min(l_shipdate) DESC, p_brand DESC LIMIT 1) AS model_version, (SELECT count(*) > 0 FROM part JOIN lineitem ON l_partkey = p_partkey) AS model_exists FROM predictions""")
def prediction_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.prediction_summary(b.predictions(spark, sf_dir), _models(spark, sf_dir), F.lit("1997-01-02").cast("timestamp_ntz"))
    return out.withColumns({c: F.round(c, 4) for c in ("avg_confidence", "avg_prediction_value")})


@query(""", h AS (SELECT venue_id, date_trunc('hour', start_time) AS hour, count(*) AS visit_count FROM ev WHERE venue_id IS NOT NULL AND start_time IS NOT NULL GROUP BY 1, 2)
SELECT h.venue_id, h.hour, h.visit_count, round((h.visit_count - p.visit_count) * 100.0::DOUBLE / p.visit_count, 4) AS trend_vs_previous_hour, round((h.visit_count - w.visit_count) * 100.0::DOUBLE / w.visit_count, 4) AS trend_vs_same_time_last_week
FROM h LEFT JOIN h p ON p.venue_id = h.venue_id AND p.hour = h.hour - INTERVAL 1 HOUR LEFT JOIN h w ON w.venue_id = h.venue_id AND w.hour = h.hour - INTERVAL 168 HOUR""")
def visit_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.visit_trends(b.events(spark, sf_dir).select("venue_id", F.col("start_time").alias("timestamp")))
    return out.withColumns({c: F.round(c, 4) for c in ("trend_vs_previous_hour", "trend_vs_same_time_last_week")})


# Map layers

_STYLE = "coalesce(nullif(avg_rating, 0), 3) / 5"
_RADIUS = "CASE WHEN {0} >= 0.8 THEN 12 WHEN {0} >= 0.6 THEN 10 WHEN {0} >= 0.4 THEN 8 WHEN {0} >= 0.2 THEN 6 ELSE 4 END"
_RATING = "coalesce(round(avg_rating, 1)::VARCHAR, 'N/A')"
_PERCENT = "printf('%.1f%%', round({0} * 100, 1))"
_TOLD = f"""told AS (SELECT venue_id, coalesce(b.prediction_value, 0) AS pv, coalesce(confidence_score, 0) AS cs FROM ({_BEST}) b JOIN predictions USING (prediction_id, venue_id)),
located AS (SELECT * FROM vf WHERE lat IS NOT NULL AND lng IS NOT NULL)"""
_TOOLTIP = f"'Venue: ' || coalesce(name, 'Unknown') || ' | Rating: ' || {_RATING} || coalesce(' | ML Prediction: ' || CASE WHEN pv IS NOT NULL THEN {_PERCENT.format('pv')} END, '')"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = b.predictions(spark, sf_dir).select("prediction_id", "confidence_score")
    return best_prediction_per_venue(spark, sf_dir).join(scores, "prediction_id").select("venue_id", "prediction_value", "confidence_score")


@full(f""", {_TOLD} SELECT venue_id, round(lat, 4) AS lat, round(lng, 4) AS lng, {_RADIUS.format(_STYLE)} AS radius, {_sql_colour(_STYLE, 'default')} AS colour, {_TOOLTIP} AS tooltip, name, category, {_RATING} AS rating, address, provider,
CASE WHEN pv IS NULL THEN NULL WHEN pv >= 0.7 THEN '#d73027' WHEN pv >= 0.5 THEN '#fc8d59' WHEN pv >= 0.3 THEN '#fee08b' ELSE '#91bfdb' END AS prediction_colour, CASE WHEN pv IS NOT NULL THEN {_PERCENT.format('pv')} END AS likelihood, CASE WHEN pv IS NOT NULL THEN {_PERCENT.format('cs')} END AS confidence FROM located LEFT JOIN told USING (venue_id)""")
def venue_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = maps.venue_markers(b.venues(spark, sf_dir), _told(spark, sf_dir))
    return m.select(F.col("id").alias("venue_id"), r4("lat", "lat"), r4("lng", "lng"), "radius", "colour", "tooltip", "popup.name", "popup.category", "popup.rating", "popup.address", "popup.provider", F.col("prediction.colour").alias("prediction_colour"), "prediction.likelihood", "prediction.confidence")


@full(f""", {_TOLD}, hot AS (SELECT prediction_id, venue_id, prediction_value FROM predictions JOIN located USING (venue_id) WHERE prediction_value > 0)
SELECT 'venue' AS layer, venue_id AS id, round(lat, 4) AS lat, round(lng, 4) AS lng, {_RADIUS.format(_STYLE)} AS radius, {_sql_colour(_STYLE, 'default')} AS colour, {_TOOLTIP} AS tooltip, NULL::DOUBLE AS intensity FROM located LEFT JOIN told USING (venue_id)
UNION ALL SELECT 'event', event_id, round(lat, 4), round(lng, 4), 8, {_sql_colour('0.5', 'default')}, 'Event: ' || e.name, NULL FROM ef e JOIN located USING (venue_id)
UNION ALL SELECT 'heat', prediction_id, round(lat, 4), round(lng, 4), NULL, NULL, NULL, round(greatest(0.1, prediction_value / (SELECT max(prediction_value) FROM hot)), 4) FROM hot JOIN located USING (venue_id)""")
def combined_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = maps.combined(b.venues(spark, sf_dir), b.events_full(spark, sf_dir), b.predictions(spark, sf_dir), _told(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("lat", "lng", "intensity")})


@full(", placed AS (SELECT lat, lng FROM vf UNION ALL SELECT lat, lng FROM ef JOIN vf USING (venue_id) UNION ALL SELECT lat, lng FROM predictions JOIN vf USING (venue_id)) SELECT coalesce(round(avg(lat), 4), 39.0997) AS lat, coalesce(round(avg(lng), 4), -94.5786) AS lng FROM placed WHERE lat IS NOT NULL AND lng IS NOT NULL")
def map_center_of_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).select("venue_id", "lat", "lng")
    layers = [df.select("venue_id").join(v, "venue_id") for df in (b.events(spark, sf_dir), b.predictions(spark, sf_dir))]
    return maps.centre(v, *layers).select(r4("lat", "lat"), r4("lng", "lng"))


@query(f", {_HEAT} SELECT cell, round(value, 4) AS prediction_value, 0.4::DOUBLE AS confidence_score, 0 AS venue_count, 'grid_prediction' AS area_type FROM heat WHERE value > 0.1")
def grid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = geo.grid_predictions(geo.heat(geo.grid(spark), b.venues(spark, sf_dir)))
    return cells.select("cell", r4("prediction_value", "prediction_value"), "confidence_score", "venue_count", "area_type")


# Enrichment stores


@query("""SELECT demo_id, CASE WHEN demo_id % 3 = 0 THEN 1000.0::DOUBLE ELSE median_income END AS median_income, CASE WHEN demo_id % 3 <> 0 OR demo_id % 2 = 1 THEN 'survey' ELSE 'census_bureau' END AS data_source, CASE WHEN demo_id % 3 <> 0 THEN 0.5::DOUBLE END AS bachelor_degree_pct FROM demographics""")
def replace_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the places reported anew: half of them by a source that isn't named; every fifth place has no tract."""
    tract = F.when(F.col("demo_id") % 5 != 0, F.concat(F.lit("t"), F.col("demo_id").cast("string")))
    held = b.demographics(spark, sf_dir).select("demo_id", "lat", "lng", tract.alias("census_tract"), "median_income", F.lit(0.5).alias("bachelor_degree_pct"), F.lit("survey").alias("data_source"))
    new = held.where("demo_id % 3 = 0").select("demo_id", "lat", "lng", "census_tract", F.lit(1000.0).alias("median_income"))
    named = store.upsert_demographics(held, new.where("demo_id % 2 = 0"))
    return store.upsert_demographics(named, new.where("demo_id % 2 = 1").withColumn("data_source", F.lit("survey"))).select("demo_id", "median_income", "data_source", "bachelor_degree_pct")


@query(""", h AS (SELECT venue_id, date_trunc('hour', start_time) AS hour, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT venue_id, hour AS timestamp, CASE WHEN venue_id % 2 = 0 THEN 2 * n ELSE n END AS visit_count, CASE WHEN venue_id % 2 = 0 THEN NULL ELSE hour(hour) END AS hour_of_day, CASE WHEN venue_id % 2 = 0 THEN 'foot_traffic_api' ELSE 'counter' END AS provider FROM h""")
def replace_foot_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = summaries.visit_trends(b.events(spark, sf_dir).select("venue_id", F.col("start_time").alias("timestamp")))
    held = held.select("venue_id", F.col("hour").alias("timestamp"), "visit_count", F.hour("hour").alias("hour_of_day"), F.lit("counter").alias("provider"))
    return store.upsert_foot_traffic(held, held.where("venue_id % 2 = 0").select("venue_id", "timestamp", (F.col("visit_count") * 2).alias("visit_count")))


@query("""SELECT conv_id AS venue_id, role AS platform, count(*) AS rows, sum(m)::BIGINT AS mention_count, count(s) AS scored FROM (SELECT conv_id, role, length(text) AS m, turn AS s FROM conversations UNION ALL SELECT conv_id, role, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END, NULL FROM conversations WHERE turn < 2) GROUP BY 1, 2""", bridged=False)
def append_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn held, and the first two of each conversation once more, of which one says nothing of mentions."""
    c = b.table(spark, sf_dir, "conversations")
    held = c.select(F.col("conv_id").alias("venue_id"), F.col("role").alias("platform"), F.char_length("text").cast("long").alias("mention_count"), F.col("turn").cast("double").alias("sentiment_score"), F.lit(0).cast("long").alias("total_engagement"))
    new = c.where("turn < 2").select(F.col("conv_id").alias("venue_id"), F.col("role").alias("platform"), F.when(F.col("turn") % 2 == 0, F.lit(1).cast("long")).alias("mention_count"))
    out = store.append_sentiment(held, new).groupBy("venue_id", "platform")
    return out.agg(F.count("*").alias("rows"), F.sum("mention_count").alias("mention_count"), F.count("sentiment_score").alias("scored"))


@query("""SELECT s_name AS address, CASE WHEN s_suppkey % 3 = 0 THEN 39.5::DOUBLE ELSE 39.0::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) END AS formatted_address, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 7 END::BIGINT AS access_count FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""", bridged=False)
def geocode_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("address"), F.lit(-94.5).alias("lng"))
    held = s.where("s_suppkey % 2 = 0").select("address", F.lit(39.0).alias("lat"), "lng", F.lit(None).cast("string").alias("formatted_address"), F.lit(7).cast("long").alias("access_count"))
    # each new address comes twice: the row that sorts first counts
    new = s.where("s_suppkey % 3 = 0").select("address", F.explode(F.array(F.lit(39.5), F.lit(40.0))).alias("lat"), "lng", F.upper("address").alias("formatted_address"))
    return store.geocode_set(held, new).drop("lng")


@query("SELECT p_partkey AS config_key, CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR ELSE p_brand END AS config_value, CASE WHEN p_partkey % 4 = 0 THEN 'integer' ELSE 'string' END AS config_type, CASE WHEN p_partkey % 4 = 0 THEN now ELSE TIMESTAMP '2023-12-01' END AS last_modified FROM part, as_of")
def config_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    held = p.select(F.col("p_partkey").alias("config_key"), F.col("p_brand").alias("config_value"), F.lit("string").alias("config_type"), F.lit("2023-12-01").cast("timestamp_ntz").alias("last_modified"))
    new = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("config_key"), F.col("p_size").cast("string").alias("config_value"), F.lit("integer").alias("config_type"))
    return store.config_set(held, new, b.as_of())


# The stand-in model over all features

_WHOLE = f"""whole AS (SELECT m.*, coalesce(lng2, 0) AS lng, lat2, k.* EXCLUDE (venue_id) FROM ({_MATRIX}) m JOIN (SELECT venue_id, lng AS lng2, coalesce(lat, 0) AS lat2 FROM venues) USING (venue_id) JOIN (SELECT venue_id, {_sql_scores('low', sc.VENUE_KEYWORDS, 1).replace('round(', '(').replace(', 4) AS', ') AS')} FROM (SELECT venue_id, lower(name || ' ' || category) AS low FROM venues)) k USING (venue_id)),
labelled AS (SELECT venue_id, CASE WHEN round(least(greatest((avg_rating - 1) / 4 + {_BOOST} + CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 0.1 ELSE -0.2 END::DOUBLE, 0), 1), 9) > 0.5 AND avg_rating IS NOT NULL THEN 1 ELSE 0 END AS label FROM venues)"""
_SUM = " + ".join("lat2" if c == "lat" else c for c in model.FEATURES)


@query(f", {_WHOLE} SELECT venue_id, round(1 / (1 + exp(-({_SUM}) / 10)), 6) AS score FROM whole")
def stand_in_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.feature_matrix(b.venues(spark, sf_dir), b.events(spark, sf_dir), b.as_of())
    return m.select("venue_id", F.round(model.sigmoid_score(*(F.col(c) for c in model.FEATURES)), 6).alias("score"))


@query(f", {_WHOLE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(avg({'lat2' if c == 'lat' else c}), 5) AS mean, round(stddev_samp({'lat2' if c == 'lat' else c}), 5) AS std, round((SELECT avg(label) FROM labelled), 5) AS label_mean FROM whole" for c in model.FEATURES))
def stand_in_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir)
    labels = v.select("venue_id", sc.label(*(F.col(c) for c in ("avg_rating", "category", "lat", "lng"))).alias("label"))
    stats = model.statistics(model.feature_matrix(v, b.events(spark, sf_dir), b.as_of()).join(labels, "venue_id"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(f"means.{c}", 5).alias("mean"), F.round(f"stds.{c}", 5).alias("std")) for c in model.FEATURES)))
    return stats.select("n", F.round("label_mean", 5).alias("label_mean"), each.alias("f")).select("f.*", "n", "label_mean")


_N = "length(trim(source))"


@query(f"""SELECT doc_id, source IS NULL OR ({_N} BETWEEN 2 AND 200 AND regexp_matches(source, '[a-zA-Z]')) AS is_valid, round(CASE WHEN source IS NULL THEN 0.8::DOUBLE ELSE (0.8::DOUBLE + CASE WHEN {_N} < 2 THEN 0.2 WHEN {_N} > 200 THEN 0.3
WHEN NOT regexp_matches(source, '[a-zA-Z]') THEN 0.4 WHEN {_N} < 5 THEN 0.7 WHEN {_N} > 100 THEN 0.8 ELSE 1 END::DOUBLE) / 2 END, 4) AS score FROM documents""", bridged=False)
def validate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for records of a kind that has none of its own: documents, named by their source."""
    found = b.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name")).select("doc_id", q.verdict(q.generic_rules()).alias("r"))
    return found.select("doc_id", "r.is_valid", F.round("r.score", 4).alias("score"))


# The cache


@query("""WITH r AS (SELECT user_id::VARCHAR AS cache_key, event_id AS request_id, ts AS t, coalesce(event_type IN ('purchase', 'signup'), false) AS sets, props AS answer, 1 + event_id % 90 AS ttl FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, last_value(CASE WHEN sets THEN {'until': t + to_hours(ttl::INT), 'answer': answer} END IGNORE NULLS) OVER (PARTITION BY cache_key ORDER BY t, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM r)
SELECT cache_key, request_id, t AS at, coalesce(held.until > t, false) AS hit, CASE WHEN held.until > t THEN held.answer END AS answer FROM s WHERE NOT sets""", bridged=False)
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups put an answer into their user's cache, other events ask for it."""
    e = b.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("get")
    requests = e.select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp_ntz").alias("at"), kind.alias("kind"), F.col("props").alias("answer"), (1 + F.col("event_id") % 90).cast("int").alias("ttl_hours"))
    return cache.replay(requests)
