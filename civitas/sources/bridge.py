"""The domain's tables from a star schema: venues, events, predictions, demographics, weather, runs.

Everything is projected from Parquet, so filters and columns reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories in the order of their numbers.
CATEGORIES = ("restaurant", "bar", "nightclub", "theater", "museum", "sports_venue", "music_venue", "gallery")
#: The time that stands for now in reproducible results.
AS_OF = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _place(key: str) -> tuple[Column, Column]:
    lat = F.lit(38.9) + ((F.col(key) * 7919) % 4001) / F.lit(10000.0)
    lng = F.lit(-94.8) + ((F.col(key) * 6007) % 4001) / F.lit(10000.0)
    return lat, lng


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, lng = _place("c_custkey")
    located = key % 10 != 7
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return customers.select(
        key.alias("venue_id"), F.col("c_name").alias("name"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (key % 8 + 1).cast("int")).alias("category"),
        F.when(located, lat).alias("lat"), F.when(located, lng).alias("lng"), F.when(key % 6 != 5, 1 + (key % 41) / F.lit(10.0)).alias("avg_rating"),
        F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("provider"), F.col("n_name").alias("address"), ((key % 101) / F.lit(100.0)).alias("quality"),
    )


def venues_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with the rest of their columns."""
    key = F.col("venue_id")
    text = key.cast("string")
    return venues(spark, sf_dir).withColumns({
        "external_id": F.concat(F.lit("x"), text), "description": F.when(key % 4 != 0, F.concat_ws(" at ", "name", "address")), "subcategory": F.lit(None).cast("string"),
        "phone": F.when(key % 5 != 0, F.concat(F.lit("816"), F.lpad(text, 7, "0"))), "website": F.concat(F.lit("https://v"), text, F.lit(".example.com")),
        "psychographic_relevance": F.when(key % 4 != 1, F.concat(F.lit('{"fun": 0.'), (key % 10).cast("string"), F.lit("}"))), "created_at": F.lit("2023-12-01").cast("timestamp_ntz"), "updated_at": F.lit("2023-12-01").cast("timestamp_ntz"),
    })


def events_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the rest of their columns."""
    key = F.col("event_id").cast("string")
    return events(spark, sf_dir).withColumns({
        "external_id": F.concat(F.lit("e"), key), "provider": F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")), "name": F.concat(F.lit("Event "), key),
        "end_time": F.when(F.col("event_id") % 4 != 0, F.col("start_time") + F.make_dt_interval(hours=(F.col("event_id") % 30).cast("int"))), "created_at": F.lit("2023-12-01").cast("timestamp_ntz"),
    })


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("venue_id"), F.col("ts").cast("timestamp_ntz").alias("start_time"), F.col("event_type").alias("category"), "value", "props")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "psychographic_match").when(F.col("o_orderstatus") == "O", "attendance").otherwise("other")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("prediction_id"), F.col("o_custkey").alias("venue_id"), kind.alias("prediction_type"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("prediction_value"),
        ((10 - F.substring("o_orderpriority", 1, 1).cast("int")) / F.lit(10.0)).alias("confidence_score"), F.col("o_orderdate").cast("timestamp_ntz").alias("generated_at"),
        ((key % 11) / F.lit(10.0)).alias("career_driven_score"), ((key % 7) / F.lit(6.0)).alias("competent_score"), ((key % 5) / F.lit(4.0)).alias("fun_score"),
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = _place("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("demo_id"), lat.alias("lat"), lng.alias("lng"), F.col("s_acctbal").alias("median_income"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured weather and forecasts: every twentieth number is a forecast's."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.select(F.col("event_id").alias("weather_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.col("value").alias("temperature_f"), (F.col("event_id") % 20 == 0).alias("is_forecast"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection runs in order of their sequence."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source_name"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ran_at"), (F.col("value") < 100).alias("success"), F.col("value").alias("duration"), (F.col("event_id") % 50).alias("records"))


_PLACE = "CASE WHEN {c} THEN CAST({base} AS DOUBLE) + ((k * {m}) % 4001) / 10000.0::DOUBLE END"
#: The same tables in SQL, for the oracle queries.
SQL = f"""venues AS (SELECT k AS venue_id, c_name AS name, (['{"','".join(CATEGORIES)}'])[k % 8 + 1] AS category,
 {_PLACE.format(c="k % 10 <> 7", base="38.9", m=7919)} AS lat, {_PLACE.format(c="k % 10 <> 7", base="-94.8", m=6007)} AS lng,
 CASE WHEN k % 6 <> 5 THEN 1 + (k % 41) / 10.0::DOUBLE END AS avg_rating, 'p' || CAST(c_nationkey % 3 AS VARCHAR) AS provider, n_name AS address, (k % 101) / 100.0::DOUBLE AS quality
 FROM (SELECT *, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)),
ev AS (SELECT event_id, user_id AS venue_id, ts AS start_time, event_type AS category, value, props FROM events),
predictions AS (SELECT o_orderkey AS prediction_id, o_custkey AS venue_id, CASE o_orderstatus WHEN 'F' THEN 'psychographic_match' WHEN 'O' THEN 'attendance' ELSE 'other' END AS prediction_type,
 least(o_totalprice / 500000, 1.0::DOUBLE) AS prediction_value, (10 - CAST(o_orderpriority[1] AS INT)) / 10.0::DOUBLE AS confidence_score, o_orderdate AS generated_at,
 (o_orderkey % 11) / 10.0::DOUBLE AS career_driven_score, (o_orderkey % 7) / 6.0::DOUBLE AS competent_score, (o_orderkey % 5) / 4.0::DOUBLE AS fun_score FROM orders),
demographics AS (SELECT s_suppkey AS demo_id, {_PLACE.format(c="true", base="38.9", m=7919)} AS lat, {_PLACE.format(c="true", base="-94.8", m=6007)} AS lng, s_acctbal AS median_income FROM (SELECT *, s_suppkey AS k FROM supplier)),
weather AS (SELECT event_id AS weather_id, ts AS timestamp, value AS temperature_f, event_id % 20 = 0 AS is_forecast FROM events WHERE event_type = 'view'),
runs AS (SELECT event_type AS source_name, event_id AS seq, ts AS ran_at, value < 100 AS success, value AS duration, event_id % 50 AS records FROM events),
as_of AS (SELECT TIMESTAMP '{AS_OF}' AS now)"""
#: The full tables in SQL.
FULL = """vf AS (SELECT *, 'x' || venue_id AS external_id, CASE WHEN venue_id % 4 <> 0 THEN name || ' at ' || address END AS description, NULL::VARCHAR AS subcategory,
 CASE WHEN venue_id % 5 <> 0 THEN '816' || lpad(venue_id::VARCHAR, 7, '0') END AS phone, 'https://v' || venue_id || '.example.com' AS website,
 CASE WHEN venue_id % 4 <> 1 THEN '{"fun": 0.' || (venue_id % 10) || '}' END AS psychographic_relevance, TIMESTAMP '2023-12-01' AS created_at, TIMESTAMP '2023-12-01' AS updated_at FROM venues),
ef AS (SELECT *, 'e' || event_id AS external_id, 'p' || (event_id % 3) AS provider, 'Event ' || event_id AS name,
 CASE WHEN event_id % 4 <> 0 THEN start_time + to_hours((event_id % 30)::INT) END AS end_time, TIMESTAMP '2023-12-01' AS created_at FROM ev)"""
