"""Registered queries over whole records: full views, readers, domain merges, caches, collection, map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.functions import quality as q
from civitas.functions import scoring as sc
from civitas.functions import text as tx
from civitas.operators import collect, joins, merge, model, reader, store
from civitas.plans.queries import _BEST, _MATRIX, _NEAREST, _nearest, _sql_scores, best_prediction_per_venue, query, r4
from civitas.sources import bridge as b
from civitas.sources import catalog


def full(sql: str):
    """Register a function under its name, with SQL over the full tables."""
    return query(f", {b.FULL} {sql}")


_V = "venue_id, external_id, provider, name, description, category, subcategory, round(lat, 4) AS lat, round(lng, 4) AS lng, address, phone, website, avg_rating, psychographic_relevance, created_at, updated_at"


def _venue_columns(df: DataFrame) -> DataFrame:
    return df.select("venue_id", "external_id", "provider", "name", "description", "category", "subcategory", r4("lat", "lat"), r4("lng", "lng"), "address", "phone", "website", "avg_rating", "psychographic_relevance", "created_at", "updated_at")


# Readers


@full(f"SELECT {_V} FROM vf WHERE category = 'museum' AND lat IS NOT NULL AND lng IS NOT NULL AND avg_rating >= 2.5")
def get_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _venue_columns(reader.get_venues(b.venues_full(spark, sf_dir), {"category": "museum", "has_location": True, "min_rating": 2.5}))


@full("SELECT e.event_id, e.external_id, e.provider, e.name, e.category, start_time, end_time, e.created_at, v.name AS venue_name, round(lat, 4) AS lat, round(lng, 4) AS lng, address FROM ef e LEFT JOIN vf v USING (venue_id) WHERE e.category = 'view' AND start_time >= TIMESTAMP '2024-01-03' AND start_time <= TIMESTAMP '2024-01-20' AND lat IS NOT NULL AND lng IS NOT NULL ORDER BY start_time DESC, event_id LIMIT 50")
def get_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events_full(spark, sf_dir).select("event_id", "venue_id", "external_id", "provider", "name", "category", "start_time", "end_time", "created_at")
    found = reader.get_events(e, b.venues_full(spark, sf_dir), {"category": "view", "start_date": "2024-01-03", "end_date": "2024-01-20", "has_location": True}, 50)
    return found.select("event_id", "external_id", "provider", "name", "category", "start_time", "end_time", "created_at", "venue_name", r4("lat", "lat"), r4("lng", "lng"), "address")


@query("SELECT prediction_id, p.venue_id, prediction_type, round(prediction_value, 4) AS prediction_value, confidence_score, generated_at, name AS venue_name, round(lat, 4) AS lat, round(lng, 4) AS lng FROM predictions p LEFT JOIN venues v USING (venue_id) WHERE p.venue_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def get_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = b.events(spark, sf_dir).where("category = 'purchase'").select("venue_id")
    p = b.predictions(spark, sf_dir).select("prediction_id", "venue_id", "prediction_type", "prediction_value", "confidence_score", "generated_at")
    return reader.get_predictions(p, b.venues(spark, sf_dir), wanted).withColumns({c: F.round(c, 4) for c in ("prediction_value", "lat", "lng")})


@full("SELECT event_id, name, category, start_time, end_time FROM ef WHERE event_id = 77")
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.by_id(b.events_full(spark, sf_dir), "event_id", 77).select("event_id", "name", "category", "start_time", "end_time")


@query("SELECT prediction_id, venue_id, prediction_type, round(prediction_value, 4) AS prediction_value FROM predictions WHERE prediction_id = 7")
def prediction_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.by_id(b.predictions(spark, sf_dir), "prediction_id", 7).select("prediction_id", "venue_id", "prediction_type", r4("prediction_value", "prediction_value"))


@query("SELECT category, count(*) AS n FROM venues WHERE avg_rating >= 3 AND provider = 'p1' GROUP BY 1")
def ask_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.ask(b.venues(spark, sf_dir), "SELECT category, count(*) AS n FROM {rows} WHERE avg_rating >= :least AND provider = :provider GROUP BY 1", least=3, provider="p1")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id LIMIT 100", bridged=False)
def sentiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("platform"))
    found = reader.read(rows, reader.SENTIMENT_FILTERS, {"platform": "user", "venue_id": None}, [F.desc("turn"), F.col("conv_id")], 100)
    return found.select("conv_id", "turn", F.col("platform").alias("role"))


# Views


@full("SELECT v.venue_id, v.name, round(lat, 4) AS lat, round(lng, 4) AS lng, category, avg_rating, address, psychographic_relevance, round(prediction_value, 4) AS prediction_value, confidence_score FROM vf v LEFT JOIN predictions p USING (venue_id) WHERE lat IS NOT NULL AND lng IS NOT NULL")
def venues_for_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues_full(spark, sf_dir).where("lat IS NOT NULL AND lng IS NOT NULL").select("venue_id", "name", "lat", "lng", "category", "avg_rating", "address", "psychographic_relevance")
    both = v.join(b.predictions(spark, sf_dir).select("venue_id", "prediction_value", "confidence_score"), "venue_id", "left")
    return both.orderBy(F.desc(F.coalesce("prediction_value", F.lit(0.0)))).withColumns({c: F.round(c, 4) for c in ("prediction_value", "lat", "lng")})


@full(f"""SELECT v.*, n.median_income, round(p.prediction_value, 4) AS prediction_value, p.confidence_score, p.career_driven_score, round(p.competent_score, 4) AS competent_score, p.fun_score, coalesce(u.n, 0) AS upcoming_events_count
FROM (SELECT {_V} FROM vf) v LEFT JOIN ({_NEAREST}) n USING (venue_id)
LEFT JOIN (SELECT * FROM predictions WHERE prediction_type = 'psychographic_match' QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY generated_at DESC, prediction_id) = 1) p USING (venue_id)
LEFT JOIN (SELECT venue_id, count(DISTINCT event_id) AS n FROM ev, as_of WHERE start_time > now GROUP BY 1) u USING (venue_id)""")
def master_venue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = b.predictions(spark, sf_dir).where("prediction_type = 'psychographic_match'")
    latest = joins.first_per(matches, ["venue_id"], [F.desc("generated_at"), F.col("prediction_id")])
    latest = latest.select("venue_id", r4("prediction_value", "prediction_value"), "confidence_score", "career_driven_score", r4("competent_score", "competent_score"), "fun_score")
    coming = b.events(spark, sf_dir).where(F.col("start_time") > b.as_of()).groupBy("venue_id").agg(F.count_distinct("event_id").alias("upcoming_events_count"))
    out = _venue_columns(b.venues_full(spark, sf_dir)).join(_nearest(spark, sf_dir).select("venue_id", "median_income"), "venue_id", "left")
    return out.join(latest, "venue_id", "left").join(coming, "venue_id", "left").withColumn("upcoming_events_count", F.coalesce("upcoming_events_count", F.lit(0)))


@full("""SELECT e.event_id, e.external_id, e.provider, e.name, e.category, start_time, end_time, v.name AS venue_name, round(lat, 4) AS lat, round(lng, 4) AS lng, v.address AS venue_address, v.category AS venue_category, v.avg_rating AS venue_rating, w.weather_id, w.temperature_f
FROM ef e LEFT JOIN vf v USING (venue_id) LEFT JOIN weather w ON is_forecast AND abs(epoch(start_time) - epoch(w.timestamp)) < 3600 WHERE start_time >= TIMESTAMP '2024-01-15'""")
def master_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    e = b.events_full(spark, sf_dir).where(F.col("start_time") >= b.as_of()).select("event_id", "venue_id", "external_id", "provider", "name", "category", "start_time", "end_time", micro("start_time").alias("e_at"))
    w = b.weather(spark, sf_dir).where("is_forecast").select("weather_id", "temperature_f", micro("timestamp").alias("w_at"))
    v = b.venues_full(spark, sf_dir).select("venue_id", F.col("name").alias("venue_name"), r4("lat", "lat"), r4("lng", "lng"), F.col("address").alias("venue_address"), F.col("category").alias("venue_category"), F.col("avg_rating").alias("venue_rating"))
    return joins.band_join(e.join(v, "venue_id", "left"), w, [("e_at", "w_at", 3600)], deal=["event_id"]).drop("venue_id", "e_at", "w_at")


@full("SELECT venue_id, name, category, round(lat, 4) AS lat, round(lng, 4) AS lng, address, round(prediction_value, 4) AS prediction_value, confidence_score, career_driven_score, round(competent_score, 4) AS competent_score, fun_score, round(career_driven_score * 0.35::DOUBLE + competent_score * 0.30::DOUBLE + fun_score * 0.35::DOUBLE, 4) AS psychographic_fit_score FROM vf JOIN predictions USING (venue_id) WHERE prediction_type = 'psychographic_match' AND prediction_value >= 0.6 AND confidence_score >= 0.7")
def high_value_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.predictions(spark, sf_dir).where("prediction_type = 'psychographic_match' AND prediction_value >= 0.6 AND confidence_score >= 0.7")
    fit = sc.fit(*(F.col(c) for c in ("career_driven_score", "competent_score", "fun_score")))
    p = p.select("venue_id", r4("prediction_value", "prediction_value"), "confidence_score", "career_driven_score", r4("competent_score", "competent_score"), "fun_score", r4(fit, "psychographic_fit_score"))
    v = b.venues_full(spark, sf_dir).select("venue_id", "name", "category", r4("lat", "lat"), r4("lng", "lng"), "address")
    return v.join(p, "venue_id").orderBy(F.desc("psychographic_fit_score"))


@full("""SELECT 'venues' AS table_name, count(*) AS total_records, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS records_with_location, count(avg_rating) AS records_with_rating, count(psychographic_relevance) AS records_with_psychographic, round(avg(quality), 4) AS avg_quality_score FROM vf
UNION ALL SELECT 'events', count(*), count(lat), count(start_time), count(props), 0 FROM ef LEFT JOIN (SELECT venue_id, lat FROM vf) USING (venue_id)""")
def quality_summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["total_records", "records_with_location", "records_with_rating", "records_with_psychographic", "avg_quality_score"]
    summed = lambda *c: [x.alias(k) for x, k in zip(c, columns)]
    both = F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    v = b.venues_full(spark, sf_dir).agg(*summed(F.count("*"), both, F.count("avg_rating"), F.count("psychographic_relevance"), F.round(F.avg("quality"), 4)))
    e = b.events_full(spark, sf_dir).join(b.venues(spark, sf_dir).select("venue_id", "lat", "lng"), "venue_id", "left").agg(*summed(F.count("*"), both, F.count("start_time"), F.count("props"), F.lit(0.0)))
    return v.select(F.lit("venues").alias("table_name"), *columns).unionByName(e.select(F.lit("events").alias("table_name"), *columns))


_STATUS = """st AS (SELECT source_name, count(*) AS total_runs, count(*) FILTER (success) AS successful_runs, count(*) FILTER (NOT success) AS error_count, max(ran_at) FILTER (success) AS last_successful_collection, max(ran_at) AS last_attempted_collection,
 count(*) FILTER (seq > coalesce(good, -1)) AS consecutive_errors, coalesce(sum(records) FILTER (success), 0)::BIGINT AS total_records_collected, arg_max(records, seq) FILTER (success) AS records_last_run, round(arg_max(duration, seq) FILTER (success), 3) AS last_duration_seconds,
 list_reduce(list_prepend(5, list(CASE WHEN success THEN 1 ELSE -2 END ORDER BY seq)), lambda a, x: least(10, greatest(0, a + x))) / 10 AS collection_health_score
 FROM runs LEFT JOIN (SELECT source_name, max(seq) FILTER (success) AS good FROM runs GROUP BY 1) USING (source_name) GROUP BY 1)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.full_status(b.runs(spark, sf_dir)).withColumn("last_duration_seconds", F.round("last_duration_seconds", 3))


@query(f", {_STATUS} SELECT * FROM st")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f""", {_STATUS}, seeds AS (SELECT * FROM (VALUES ('click', 'api', true, 100, 40), ('view', 'scraped', true, 0, 5), ('purchase', 'api', false, 50, 60), ('error', 'scraped', true, 10, 1), ('idle', 'scraped', true, NULL, 0)) t(source_name, source_type, is_enabled, daily_quota, requests_made_today))
SELECT source_name, source_type, is_enabled, collection_health_score, last_successful_collection, CASE WHEN last_successful_collection IS NULL THEN 'Never Run' WHEN last_successful_collection < now - INTERVAL 24 HOUR THEN 'Stale' WHEN consecutive_errors > 3 THEN 'Failing' WHEN collection_health_score < 0.5 THEN 'Unhealthy' ELSE 'Healthy' END AS status,
coalesce(error_count, 0) AS error_count, coalesce(consecutive_errors, 0) AS consecutive_errors, coalesce(total_records_collected, 0) AS total_records_collected, records_last_run, requests_made_today, daily_quota, CASE WHEN daily_quota > 0 THEN requests_made_today::DOUBLE / daily_quota ELSE 0 END AS quota_used_pct FROM seeds LEFT JOIN st USING (source_name), as_of""")
def collection_health_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = [("click", "api", True, 100, 40), ("view", "scraped", True, 0, 5), ("purchase", "api", False, 50, 60), ("error", "scraped", True, 10, 1), ("idle", "scraped", True, None, 0)]
    return merge.health(spark.createDataFrame(seeds, "source_name string, source_type string, is_enabled boolean, daily_quota int, requests_made_today int"), _status(spark, sf_dir), b.as_of())


# Merges


@full(f"""SELECT external_id, provider, coalesce(s.name, t.name) AS name, CASE WHEN s.external_id IS NULL THEN t.phone END AS phone, CASE WHEN s.external_id IS NULL THEN t.avg_rating ELSE 5.0 END AS avg_rating, coalesce(t.created_at, TIMESTAMP '2024-01-15') AS created_at, CASE WHEN s.external_id IS NULL THEN t.updated_at ELSE TIMESTAMP '2024-01-15' END AS updated_at
FROM (SELECT * FROM vf WHERE venue_id % 3 <> 0) t FULL JOIN (SELECT external_id, provider, upper(name) AS name FROM vf WHERE venue_id % 2 = 0) s USING (external_id, provider)""")
def upsert_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues_full(spark, sf_dir)
    new = v.where("venue_id % 2 = 0").select("venue_id", "external_id", "provider", F.upper("name").alias("name"), F.lit(5.0).alias("avg_rating"))
    out = store.upsert_venues(v.where("venue_id % 3 <> 0"), new, b.as_of())
    return out.select("external_id", "provider", "name", "phone", "avg_rating", "created_at", "updated_at")


@full("SELECT count(*) FILTER (venue_id % 3 <> 0) AS updated, count(*) FILTER (venue_id % 3 = 0) AS inserted FROM vf WHERE venue_id % 2 = 0")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues_full(spark, sf_dir)
    return store.affected(v.where("venue_id % 3 <> 0"), v.where("venue_id % 2 = 0"), ["external_id", "provider"])


@full("""SELECT event_id, coalesce(v.venue_id::VARCHAR, 'new') AS venue, CASE WHEN v.venue_id IS NULL THEN provider || '_' || replace(lower(venue_name), ' ', '_') END AS created FROM
(SELECT event_id, 'p' || (event_id % 3) AS provider, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'CUSTOMER#' || lpad((event_id % 100)::VARCHAR, 9, '0') ELSE 'New Hall ' || event_id END AS venue_name FROM ev) e
LEFT JOIN (SELECT lower(name) AS low, min(venue_id) AS venue_id FROM vf GROUP BY 1) v ON lower(venue_name) = low WHERE venue_name IS NOT NULL""")
def upsert_events_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    name = F.when(key % 5 == 0, None).when(key % 2 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad((key % 100).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("New Hall "), key.cast("string")))
    none = F.lit(None).cast("double")
    e = b.events(spark, sf_dir).select("event_id", F.concat(F.lit("p"), (key % 3).cast("string")).alias("provider"), name.alias("venue_name"), none.alias("lat"), none.alias("lng"), F.lit(None).cast("string").alias("address"))
    found, new = store.resolve_venues(e, b.venues_full(spark, sf_dir))
    return found.join(new.select("venue_id", F.col("external_id").alias("created")), "venue_id", "left").select("event_id", F.when(F.col("created").isNull(), F.col("venue_id")).otherwise("new").alias("venue"), "created")


@query("""SELECT venue_id, prediction_type, CASE WHEN s.venue_id IS NOT NULL THEN 0.5 ELSE round(t.prediction_value, 4) END AS prediction_value, CASE WHEN s.venue_id IS NOT NULL THEN TIMESTAMP '2024-01-15' ELSE t.generated_at END AS generated_at
FROM (SELECT venue_id, prediction_type, arg_max(prediction_value, (generated_at, -prediction_id)) AS prediction_value, max(generated_at) AS generated_at FROM predictions GROUP BY 1, 2) t FULL JOIN (SELECT venue_id, 'attendance' AS prediction_type FROM venues WHERE venue_id % 7 = 0) s USING (venue_id, prediction_type)""")
def upsert_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["venue_id", "prediction_type"]
    held = store.latest(b.predictions(spark, sf_dir).select(*keys, "prediction_id", "prediction_value", "generated_at"), keys, [F.desc("generated_at"), F.col("prediction_id")]).drop("prediction_id")
    new = b.venues(spark, sf_dir).where("venue_id % 7 = 0").select("venue_id", F.lit("attendance").alias("prediction_type"), F.lit(0.5).alias("prediction_value"))
    return store.upsert_predictions(held, new, b.as_of()).select(*keys, r4("prediction_value", "prediction_value"), "generated_at")


@query("SELECT weather_id, CASE WHEN weather_id % 10 = 0 THEN 50.0::DOUBLE ELSE temperature_f END AS temperature_f, CASE WHEN weather_id % 10 = 0 THEN 'unknown' ELSE 'clear' END AS conditions FROM weather")
def replace_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = b.weather(spark, sf_dir).select("weather_id", "temperature_f", F.lit("clear").alias("conditions"))
    new = w.where("weather_id % 10 = 0").select("weather_id", F.lit(50.0).alias("temperature_f"))
    return store.replace(w, new, ["weather_id"], {"conditions": "unknown"})


_CACHE = "cache AS (SELECT page_id::VARCHAR AS cache_key, 'pages' AS api_source, url AS response_data, TIMESTAMP '2024-01-15' + to_hours((page_id % 5 - 2)::INT) AS expires_at, length(url)::BIGINT AS response_size_bytes, page_id % 7 <> 0 AS is_valid, TIMESTAMP '2024-01-01' AS last_accessed FROM pages)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    until = b.as_of() + F.make_dt_interval(hours=(key % 5 - 2).cast("int"))
    return b.table(spark, sf_dir, "pages").select(key.cast("string").alias("cache_key"), F.lit("pages").alias("api_source"), F.col("url").alias("response_data"), until.alias("expires_at"), F.char_length("url").cast("long").alias("response_size_bytes"), (key % 7 != 0).alias("is_valid"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_accessed"))


@query(f", {_CACHE} SELECT cache_key, expires_at, is_valid, CASE WHEN cache_key::BIGINT % 2 = 0 AND expires_at > now AND is_valid THEN now ELSE last_accessed END AS last_accessed FROM cache, as_of")
def api_cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    _, after = store.cache_get(cache, cache.where("cache_key::BIGINT % 2 = 0").select("cache_key"), b.as_of())
    return after.select("cache_key", "expires_at", "is_valid", "last_accessed")


@query(f", {_CACHE} SELECT cache_key, response_size_bytes, expires_at FROM cache, as_of WHERE expires_at >= now AND cache_key::BIGINT % 3 <> 0 UNION ALL SELECT cache_key, 3, now + to_hours((cache_key::BIGINT % 9)::INT) FROM cache, as_of WHERE cache_key::BIGINT % 3 = 0")
def api_cache_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    new = cache.where("cache_key::BIGINT % 3 = 0").select("cache_key", F.lit("own").alias("api_source"), F.lit("abc").alias("response_data"), (F.col("cache_key").cast("long") % 9).cast("int").alias("ttl_hours"))
    return store.cache_set(cache, new, b.as_of()).select("cache_key", "response_size_bytes", "expires_at")


@query("SELECT n_name AS address, round(-90 + n_nationkey / 2.0::DOUBLE, 4) AS lat, 1 + count(c_custkey) AS access_count FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey", bridged=False)
def geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = b.table(spark, sf_dir, "nation")
    cache = nations.select(F.col("n_name").alias("address"), (-90 + F.col("n_nationkey") / 2).alias("lat"), F.lit(0.0).alias("lng"), F.lit(1).cast("long").alias("access_count"))
    asked = b.table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("address"))  # 25 rows
    _, after = store.geocode(cache, asked)
    return after.select("address", r4("lat", "lat"), "access_count")


@query("""SELECT p_partkey, CASE WHEN k = 0 THEN p_size END::BIGINT AS i, CASE WHEN k = 1 THEN p_retailprice END AS f, CASE WHEN k = 2 THEN p_size % 2 = 1 END AS b, CASE WHEN k = 3 THEN p_size::VARCHAR END AS j, CASE WHEN k = 4 THEN p_brand END AS s FROM (SELECT *, p_partkey % 5 AS k FROM part)""", bridged=False)
def config_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    kind = F.element_at(F.array(*map(F.lit, ("integer", "float", "boolean", "json", "string"))), (k + 1).cast("int"))
    size = F.col("p_size").cast("string")
    yes = F.when(F.col("p_size") % 2 == 1, F.element_at(F.array(F.lit("True"), F.lit("1"), F.lit("yes")), (F.col("p_partkey") % 3 + 1).cast("int"))).otherwise("no")
    value = F.when(k == 0, size).when(k == 1, F.col("p_retailprice").cast("string")).when(k == 2, yes).when(k == 3, F.concat(F.lit('{"size": '), size, F.lit("}"))).otherwise(F.col("p_brand"))
    config = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config_key"), value.alias("config_value"), kind.alias("config_type"))
    found = store.config_get(config, config.select("config_key", F.lit("-").alias("default")))
    return found.select(F.col("config_key").alias("p_partkey"), F.col("value.integer").alias("i"), F.col("value.float").alias("f"), F.col("value.boolean").alias("b"), F.variant_get("value.json", "$.size", "string").alias("j"), F.col("value.string").alias("s"))


@full("""SELECT 'venues' AS table_name, venue_id::VARCHAR AS record_id, 'field' AS validation_type, r AS validation_result, f AS field_name, s AS severity FROM vf, (VALUES ('lat', 'failed', 'high'), ('lng', 'failed', 'high')) t(f, r, s) WHERE lat IS NULL""")
def quality_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = q.results(q.coordinate(F.col("lat"), "lat"), q.coordinate(F.col("lng"), "lng"), q.required(F.col("name"), "name"))
    return store.quality_log(b.venues_full(spark, sf_dir), "venues", "venue_id", rules, b.as_of()).drop("error_message", "logged_at")


@query(f""", {_CACHE} SELECT (SELECT count(*) FROM predictions WHERE generated_at < TIMESTAMP '2024-01-20' - INTERVAL 9000 DAY) AS predictions_removed, (SELECT count(*) FROM ev WHERE start_time < TIMESTAMP '2024-01-20' - INTERVAL 18000 DAY) AS events_removed,
(SELECT count(*) FROM weather WHERE timestamp < TIMESTAMP '2024-01-20' - INTERVAL 9000 DAY) AS weather_removed, (SELECT count(*) FROM cache WHERE expires_at < TIMESTAMP '2024-01-20') AS cache_removed""")
def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clean_up(b.predictions(spark, sf_dir), b.weather(spark, sf_dir).withColumnRenamed("timestamp", "collected_at"), _cache(spark, sf_dir), b.events(spark, sf_dir), b.venues(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz"), 9000)[1]


@query("""SELECT count(*) FILTER (start_time < TIMESTAMP '2024-02-20' - INTERVAL 40 DAY AND venue_id NOT IN (SELECT venue_id FROM venues WHERE lat IS NOT NULL)) AS events_removed, count(*) FILTER (NOT (start_time < TIMESTAMP '2024-02-20' - INTERVAL 40 DAY AND venue_id NOT IN (SELECT venue_id FROM venues WHERE lat IS NOT NULL))) AS kept FROM ev""")
def retention_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, counts = store.clean_up(b.predictions(spark, sf_dir), b.weather(spark, sf_dir).withColumnRenamed("timestamp", "collected_at"), _cache(spark, sf_dir), b.events(spark, sf_dir), b.venues(spark, sf_dir), F.lit("2024-02-20").cast("timestamp_ntz"), 20)
    return counts.select("events_removed").join(F.broadcast(kept["events"].agg(F.count("*").alias("kept"))))  # one row each


# Collection


@query("""SELECT 'pl' || c_custkey AS external_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'nightclub' WHEN 1 THEN 'restaurant' ELSE 'local_venue' END AS category, CASE c_custkey % 3 WHEN 0 THEN 'night_club' WHEN 1 THEN 'point_of_interest' END AS subcategory, n_name AS address, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 5)::DOUBLE END AS avg_rating, (c_custkey % 90)::DOUBLE AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey""", bridged=False)
def places_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kinds = F.when(key % 3 == 0, F.array(F.lit("night_club"), F.lit("bar"))).when(key % 3 == 1, F.array(F.lit("point_of_interest"), F.lit("cafe"))).otherwise(F.array().cast("array<string>"))
    place = F.struct(F.concat(F.lit("pl"), key.cast("string")).alias("place_id"), F.col("c_name").alias("name"), F.col("n_name").alias("vicinity"), F.when(key % 4 != 0, (key % 5).cast("double")).alias("rating"), kinds.alias("types"), F.struct(F.struct((key % 90).cast("double").alias("lat"), F.lit(-94.5).alias("lng")).alias("location")).alias("geometry"))
    known = b.table(spark, sf_dir, "customer").join(F.broadcast(b.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    # each place is in the answers of two searches
    answers = known.select(F.explode(F.array(key % 50, key % 50 + 50)).alias("search"), place.alias("place")).groupBy("search", F.pmod(F.xxhash64("place.place_id"), F.lit(64))).agg(F.to_json(F.struct(F.collect_list("place").alias("results"))).alias("answer"))
    return collect.places(answers.select("answer")).select("external_id", "name", "category", "subcategory", "address", "avg_rating", "lat")


_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
_PAGES = f"""titled AS (SELECT page_id, url, {_HOST} AS host, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS name FROM pages WHERE length(html) >= 500),
rows AS (SELECT 's_' || host || '_' || replace(lower(name), ' ', '_') AS external_id, 's_' || host AS provider, name, url AS website, page_id FROM titled WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY host, replace(lower(name), ' ', '_') ORDER BY page_id) = 1)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return b.table(spark, sf_dir, "pages").select(host.alias("host")).distinct().select(F.concat(F.lit("s_"), "host").alias("source_name"), "host", F.lit("local_venue").alias("category"), F.lit(True).alias("is_enabled"))


@query(f"WITH {_PAGES} SELECT external_id, provider, name, website FROM rows", bridged=False)
def page_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.page_venues(b.table(spark, sf_dir, "pages"), _sources(spark, sf_dir)).select("external_id", "provider", "name", "website")


@query(f", {_PAGES} SELECT provider, count(*) AS records, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS with_location FROM (SELECT provider, lat, lng FROM venues UNION ALL SELECT provider, NULL, NULL FROM rows) GROUP BY 1")
def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.totals(b.venues(spark, sf_dir), collect.page_venues(b.table(spark, sf_dir, "pages"), _sources(spark, sf_dir)))


@query(f"WITH {_PAGES} SELECT DISTINCT 's_' || {_HOST} AS source_name, n IS NOT NULL AS success, coalesce(n, 0) AS records FROM pages LEFT JOIN (SELECT provider, count(*) AS n FROM rows GROUP BY 1) ON provider = 's_' || {_HOST}", bridged=False)
def collection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    return collect.runs_of(sources, collect.page_venues(b.table(spark, sf_dir, "pages"), sources), b.as_of()).drop("ran_at")


@query("SELECT event_id, 'Show ' || event_id AS title, '2024-02-0' || (event_id % 9 + 1) AS date, '/e/' || event_id AS link FROM ev WHERE event_id % 2 = 0")
def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    card = F.concat(F.lit('<p>x</p><div class="event card"><h3>Show <b>'), key, F.lit('</b></h3><time datetime="2024-02-0'), (F.col("event_id") % 9 + 1).cast("string"), F.lit('">soon</time><a href="/e/'), key, F.lit('">more</a></div>'))
    pages = b.events(spark, sf_dir).select(F.col("event_id").alias("page_id"), F.when(F.col("event_id") % 2 == 0, card).otherwise("<p>nothing</p>").alias("html"))
    found = collect.event_fields(tx.first_blocks(pages, [("article", "event"), ("div", "event")]))
    return found.select(F.col("page_id").alias("event_id"), "title", "date", "link")


@query("SELECT venue_id, name, category, CASE WHEN venue_id % 3 = 0 THEN NULL ELSE (venue_id % 5)::DOUBLE END AS rating FROM venues WHERE venue_id % 4 <> 0")
def venue_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("venue_id")
    body = F.concat(F.lit('{"name": "'), "name", F.lit('", "category": "'), "category", F.lit('", "rating": '), F.when(key % 3 == 0, F.lit('"n/a"')).otherwise((key % 5).cast("string")), F.when(key % 2 == 0, F.lit(",}")).otherwise("}"))
    answer = F.when(key % 4 == 0, F.lit("I found no venue.")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
    found = b.venues(spark, sf_dir).select("venue_id", collect.venue_of_answer(answer).alias("v")).where("v IS NOT NULL")
    return found.select("venue_id", "v.name", "v.category", "v.rating")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Kid''s day ' || event_id ELSE 'Day ' || event_id END AS title FROM ev""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    forms = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"title": "Kid\'s day '), key, F.lit('",}]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[{'title': 'Day "), key, F.lit("', 'date': '2025-01-01'},]"))).otherwise(F.concat(F.lit('junk [{"title": "Day '), key, F.lit('", "date": "x",} and {"title": ]')))
    return b.events(spark, sf_dir).select("event_id", F.explode(tx.parse_events(forms)).alias("e")).select("event_id", "e.title")


# Features, scores, validators


@query(f"SELECT m.*, round(coalesce(lng2, 0), 4) AS lng, k.* EXCLUDE (venue_id) FROM ({_MATRIX}) m JOIN (SELECT venue_id, lng AS lng2 FROM venues) USING (venue_id) JOIN (SELECT venue_id, {_sql_scores('low', sc.VENUE_KEYWORDS, 1)} FROM (SELECT venue_id, lower(name || ' ' || category) AS low FROM venues)) k USING (venue_id)")
def feature_matrix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.feature_matrix(b.venues(spark, sf_dir), b.events(spark, sf_dir), b.as_of())
    return m.select("venue_id", *(r4(c, c) if c in ("lat", "lng", *sc.VENUE_KEYWORDS) else F.col(c) for c in model.FEATURES))


@query(f"SELECT count(*) AS n, round(avg(avg_rating), 6) AS mean_rating, round(stddev_samp(avg_rating), 6) AS std_rating, round(avg(event_count), 6) AS mean_events, round(stddev_samp(event_count), 6) AS std_events FROM ({_MATRIX})")
def model_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = model.statistics(model.feature_matrix(b.venues(spark, sf_dir), b.events(spark, sf_dir), b.as_of()).withColumn("label", F.lit(0)))
    return stats.select("n", F.round("means.avg_rating", 6).alias("mean_rating"), F.round("stds.avg_rating", 6).alias("std_rating"), F.round("means.event_count", 6).alias("mean_events"), F.round("stds.event_count", 6).alias("std_events"))


@query("SELECT event_id, n, n - coalesce(lag1, 0) AS since_last_hour, n - coalesce(lag168, 0) AS since_last_week FROM (SELECT min(event_id) AS event_id, date_trunc('hour', start_time) AS h, count(*) AS n FROM ev GROUP BY 2) t LEFT JOIN (SELECT date_trunc('hour', start_time) + INTERVAL 1 HOUR AS h, count(*) AS lag1 FROM ev GROUP BY 1) USING (h) LEFT JOIN (SELECT date_trunc('hour', start_time) + INTERVAL 168 HOUR AS h, count(*) AS lag168 FROM ev GROUP BY 1) USING (h)")
def hourly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = b.events(spark, sf_dir).groupBy(F.date_trunc("hour", "start_time").alias("h")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    back = lambda k, name: hours.select((F.col("h") + F.expr(f"INTERVAL {k} HOURS")).alias("h"), F.col("n").alias(name))  # noqa: E731  one row an hour
    both = hours.join(back(1, "one"), "h", "left").join(back(168, "week"), "h", "left")
    return both.select("event_id", "n", *((F.col("n") - F.coalesce(c, F.lit(0))).alias(k) for c, k in (("one", "since_last_hour"), ("week", "since_last_week"))))


_DESC = "CASE WHEN description IS NULL THEN NULL WHEN length(trim(description)) < 10 THEN 0.6 WHEN length(trim(description)) > 2000 THEN 0.3 WHEN length(trim(description)) < 50 THEN 0.7 ELSE 1 END"
_KNOWN = "category IN ('" + "','".join(q.VENUE_CATEGORIES) + "')"
_PHONE = "CASE WHEN phone IS NULL THEN NULL ELSE 1 END"


@full(f"""SELECT venue_id, lat IS NOT NULL AND lng IS NOT NULL AND {_KNOWN} AND coalesce({_DESC}, 1) >= 0.7 AS is_valid, round(list_avg(list_filter([1.0, 1, 1, 1, {_DESC}, CASE WHEN {_KNOWN} THEN 1 ELSE 0.5 END, CASE WHEN lat IS NULL THEN 0 WHEN lat BETWEEN 38.5 AND 39.5 THEN 1 ELSE 0.7 END, CASE WHEN lng IS NULL THEN 0 WHEN lng BETWEEN -95 AND -94 THEN 1 ELSE 0.7 END,
{_PHONE}, 1, CASE WHEN avg_rating IS NULL THEN NULL ELSE 1 END, CASE WHEN psychographic_relevance IS NULL THEN NULL ELSE 1 END]::DOUBLE[], lambda x: x IS NOT NULL)), 4) AS score FROM vf""")
def validate_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.venues_full(spark, sf_dir).select("venue_id", q.verdict(q.venue_rules()).alias("r"))
    return found.select("venue_id", "r.is_valid", F.round("r.score", 4).alias("score"))


_DAYS = "floor((epoch(start_time) - epoch(now)) / 86400)"


@full(f"""SELECT event_id, category IN ('{"','".join(q.EVENT_CATEGORIES)}') AS is_valid, round(list_avg(list_filter([1.0, 1, 1, 1, CASE WHEN category IN ('{"','".join(q.EVENT_CATEGORIES)}') THEN 1 ELSE 0.5 END, CASE WHEN {_DAYS} < -30 THEN 0.6 WHEN {_DAYS} > 365 THEN 0.7 ELSE 1 END,
CASE WHEN end_time IS NULL THEN NULL WHEN event_id % 30 > 24 THEN 0.7 ELSE 1 END]::DOUBLE[], lambda x: x IS NOT NULL)), 4) AS score FROM ef, as_of""")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.events_full(spark, sf_dir).withColumns({"description": F.lit(None).cast("string"), "psychographic_relevance": F.lit(None).cast("string")})
    found = e.select("event_id", q.verdict(q.event_rules(b.as_of())).alias("r"))
    return found.select("event_id", "r.is_valid", F.round("r.score", 4).alias("score"))


@query("""SELECT p_partkey, ok AS is_valid, round((1.0::DOUBLE + CASE WHEN k IN (0, 1) THEN 1 WHEN k = 2 THEN 0.7 ELSE 0.7 END + CASE k WHEN 0 THEN 1 WHEN 1 THEN 0.3 WHEN 2 THEN 0 ELSE 0.6 END + CASE WHEN p_size > 40 THEN 0 ELSE 1 END) / 4, 4) AS score FROM (SELECT *, p_partkey % 4 AS k, p_partkey % 4 = 0 AND p_size <= 40 AS ok FROM part)""", bridged=False)
def validate_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    version = F.element_at(F.array(*map(F.lit, ("v1.0", "2.3.1", "one", "v1.x"))), (k + 1).cast("int"))
    features = F.element_at(F.array(*map(F.lit, ('["lat", "lng"]', "[]", "lat", '["lat", 3]'))), (k + 1).cast("int"))
    rules = q.results(q.required(F.col("p_brand"), "brand"), q.model_version(version), q.feature_list(features), q.within(F.col("p_size"), "size", 0, 40))
    found = b.table(spark, sf_dir, "part").select("p_partkey", q.verdict(rules).alias("r"))
    return found.select("p_partkey", "r.is_valid", F.round("r.score", 4).alias("score"))


@query("""SELECT records, round(completeness, 4) AS completeness, round(consistency, 4) AS consistency, round(accuracy, 4) AS accuracy, round(0.3 * completeness + 0.4 * accuracy + 0.3 * consistency, 4) AS quality FROM (SELECT count(*) AS records, (count(name) + count(category) + count(lat)) / (3.0::DOUBLE * count(*)) AS completeness, avg(CASE WHEN lat IS NULL THEN 0.5 ELSE 1 END) AS accuracy,
((1 - (count(DISTINCT provider) - 1) / count(provider)) + (1 - (count(DISTINCT category) - 1) / count(category))) / 2 AS consistency FROM venues)""")
def dataset_quality_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q.dataset_quality(b.venues(spark, sf_dir), ["name", "category", "lat"], q.results(q.name(F.col("name")), q.coordinate(F.col("lat"), "lat")))
    return out.select("records", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("completeness", "consistency", "accuracy", "quality")))


# Map layers and catalog


def _sql_colour(score: str, scheme: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{c}'" for least, c in zip((0.8, 0.6, 0.4, 0.2), sc.SCHEMES[scheme])) + f" ELSE '{sc.SCHEMES[scheme][4]}' END"


@full(f"""SELECT 'event' AS layer, event_id AS id, 8 AS radius, {_sql_colour('0.5', 'scraped')} AS colour, 'Event: ' || e.name AS tooltip FROM ef e JOIN vf v USING (venue_id) WHERE lat IS NOT NULL AND lng IS NOT NULL
UNION ALL SELECT 'prediction', prediction_id, CASE WHEN s >= 0.8 THEN 12 WHEN s >= 0.6 THEN 10 WHEN s >= 0.4 THEN 8 WHEN s >= 0.2 THEN 6 ELSE 4 END, {_sql_colour('s', 'calculated')}, 'Prediction: ' || printf('%.3f', s) FROM (SELECT prediction_id, round(prediction_value, 3) AS s, venue_id FROM predictions) JOIN vf USING (venue_id) WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def map_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).where("lat IS NOT NULL AND lng IS NOT NULL").select("venue_id")
    m = sc.marker(F.lit(0.5), "scraped")
    events = b.events_full(spark, sf_dir).join(v, "venue_id").select(F.lit("event").alias("layer"), F.col("event_id").alias("id"), m["radius"].alias("radius"), m["colour"].alias("colour"), F.concat(F.lit("Event: "), "name").alias("tooltip"))
    s = sc.rounded(F.col("prediction_value"), 3)
    m = sc.marker(s, "calculated")
    predicted = b.predictions(spark, sf_dir).join(v, "venue_id").select(F.lit("prediction").alias("layer"), F.col("prediction_id").alias("id"), F.greatest(F.lit(4), m["radius"]).alias("radius"), m["colour"].alias("colour"), F.concat(F.lit("Prediction: "), F.format_string("%.3f", s)).alias("tooltip"))
    return events.unionByName(predicted)


@full("SELECT event_id, e.name, coalesce(v.name, 'Unknown') AS venue_name, e.category, e.provider, strftime(start_time, '%Y-%m-%d') AS day FROM ef e LEFT JOIN vf v USING (venue_id)")
def event_popups(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.venues(spark, sf_dir).select("venue_id", F.col("name").alias("venue_name"))
    p = b.events_full(spark, sf_dir).join(named, "venue_id", "left").select("event_id", sc.event_popup().alias("p"))
    return p.select("event_id", "p.name", "p.venue_name", "p.category", "p.provider", F.substring("p.start_time", 1, 10).alias("day"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('minute', start_time) WHEN 1 THEN date_trunc('day', start_time) END AS parsed FROM ev")
def date_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, kind = F.col("start_time"), F.col("event_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("Doors open "), F.date_format(at, "EEEE, MMM d"), F.lit(" at "), F.date_format(at, "h:mm a"))).when(kind == 1, F.concat(F.lit("on "), F.date_format(at, "MMMM d, yyyy"), F.lit(" all day"))).otherwise("every day")
    return b.events(spark, sf_dir).select("event_id", tx.fuzzy_time(text, b.as_of()).alias("parsed"))


@query("SELECT 'venues' AS name, count(*) AS records FROM venues UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'predictions', count(*) FROM predictions UNION ALL SELECT 'demographics', count(*) FROM demographics UNION ALL SELECT 'weather', count(*) FROM weather UNION ALL SELECT 'runs', count(*) FROM runs")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts(spark, sf_dir)


@query(f"SELECT event_id, round(p.prediction_value, 4) AS base, round(p.confidence_score * 0.9::DOUBLE, 4) AS confidence_score FROM ev LEFT JOIN (SELECT b.venue_id, b.prediction_value, confidence_score FROM ({_BEST}) b JOIN predictions USING (prediction_id)) p USING (venue_id)")
def event_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_prediction_per_venue(spark, sf_dir).join(b.predictions(spark, sf_dir).select("prediction_id", "confidence_score"), "prediction_id")
    both = b.events(spark, sf_dir).select("event_id", "venue_id").join(best.select("venue_id", "prediction_value", "confidence_score"), "venue_id", "left")
    return both.select("event_id", r4("prediction_value", "base"), F.round(F.col("confidence_score") * 0.9, 4).alias("confidence_score"))
