"""Registered queries that read pages and answers (cards by selector, Markdown, mended JSON, dates), and stores laid out by key or place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.functions import text as tx
from civitas.operators import buckets, collect, geo, reader
from civitas.operators import pages as pg
from civitas.operators.chain import collect_events
from civitas.plans.queries import query
from civitas.plans.records import full
from civitas.sources import bridge as b
from civitas.staging import shared_dir


def _sql_plain(text: str) -> str:
    """Character references as they stand in the pages."""
    return f"regexp_replace(replace(replace(replace({text}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


_TAGLESS = r"trim(regexp_replace({0}, '\s*<[^>]*>\s*', '', 'g'))"


@query(
    f"""WITH nav AS (SELECT page_id, url, list_slice(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>'), 1, {pg.MOST_CARDS}) AS items FROM pages),
each AS (SELECT page_id, url, i - 1 AS place, items[i] AS item FROM nav, unnest(range(1, len(items) + 1)) t(i))
SELECT page_id, place::INTEGER AS place, {_sql_plain(_TAGLESS.format('item'))} AS title, regexp_extract(url, '^(https?://[^/]+)', 1) || {_sql_plain("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS url
FROM each WHERE length({_sql_plain(_TAGLESS.format('item'))}) >= {pg.LEAST_TITLE}""",
    bridged=False,
)
def page_link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.table(spark, sf_dir, "pages").withColumn("selectors", F.array(F.lit(".event"), F.lit("nav > ul li")))
    return pg.event_cards(own).select("page_id", "place", "title", "url")


_FIRST = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_REST = "regexp_extract(body, '(?s)</h1>(.*)', 1)"


@query(
    f"""WITH body AS (SELECT page_id, {_FIRST} AS body FROM pages), cut AS (SELECT page_id, {_sql_plain(_TAGLESS.format("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)"))} AS title,
{_sql_plain(_TAGLESS.format(f"CASE WHEN {_REST} LIKE '<p><b>%' THEN {_REST} ELSE regexp_extract({_REST}, '(?s)<p>(.*?)</p>', 1) END"))} AS text FROM body)
SELECT page_id, title, CASE WHEN length(text) >= {pg.GOOD_TEXT} THEN left(text, {pg.MOST_TEXT}) END AS description FROM cut WHERE length(title) >= {pg.LEAST_TITLE}""",
    bridged=False,
)
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.table(spark, sf_dir, "pages").withColumn("selectors", F.array(*map(F.lit, (*pg.CARDS, "article"))))
    return pg.event_cards(own).select("page_id", "title", "description")


def _sql_markdown(dropped: tuple[str, ...], most: int, cut: str) -> str:
    s = "regexp_replace(translate(html, chr(10) || chr(13), '  '), '(?s)<!--.*?-->', '', 'g')"
    for tag in dropped:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    s = f"regexp_replace(replace({s}, '<h1>', '<h1># '), '</?(p|div|article|h1|title|html|body|ul|li)\\b[^>]*>', chr(10), 'g')"
    s = f"regexp_replace(regexp_replace({s}, '<[^>]*>', '', 'g'), '[ \\t\\r]+', ' ', 'g')"
    s = f"trim(regexp_replace({s}, ' ?\\n[ \\n]*', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    return f"SELECT page_id, CASE WHEN length(m) > {most} THEN left(m, {most}) || '{cut}' ELSE m END AS markdown FROM (SELECT page_id, {_sql_plain(s)} AS m FROM pages)".replace("\n", "' || chr(10) || '")


@query(_sql_markdown(*pg.EVENT_PAGE), bridged=False)
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.as_markdown(b.table(spark, sf_dir, "pages"))


@query("SELECT doc_id, 'it''s \"' || doc_id || '\", {x}' AS title, text AS description, source AS location FROM documents WHERE doc_id IS NOT NULL", bridged=False)
def answers_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with whatever quotes, commas and brackets they hold, as values of answers that need mending."""
    docs = b.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    title = F.concat(F.lit("it's \\\""), F.col("doc_id").cast("string"), F.lit('\\", {x}'))
    value = F.regexp_extract(F.to_json(F.struct("text"), {"ignoreNullFields": "false"}), r'(?s)^\{"text":(.*)\}$', 1)
    place = F.regexp_extract(F.to_json(F.struct("source"), {"ignoreNullFields": "false"}), r'(?s)^\{"source":(.*)\}$', 1)
    answer = F.concat(F.lit("Here they are, [in short]:\n```json\n[{'title': \""), title, F.lit("\", 'description': "), value, F.lit(' , "location": '), place, F.lit(",\n},]\n```"))
    answer = F.regexp_replace(answer, r"^Here they are, \[in short\]:", "Here they are:")
    found = docs.select("doc_id", F.explode(tx.parse_events(answer)).alias("e"))
    return found.select("doc_id", "e.title", "e.description", "e.location")


_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "MMM d, yyyy 'at' h:mm a", "d MMMM yyyy, HH:mm", "MMMM d yyyy HH:mm", "MM-dd-yyyy HH:mm", "M/d/yy h:mm a", "EEE, d MMM yyyy HH:mm:ss", "EEEE, MMMM d 'doors' h:mm a", "yyyyMMdd'T'HHmmss", "d. MMM. yyyy", "EEEE 'night'")


@query(
    """SELECT event_id, CASE WHEN k = 11 THEN now + INTERVAL (((dayofweek(start_time) + 6) % 7 + 7 - (dayofweek(now) + 6) % 7) % 7) DAY WHEN k = 10 THEN date_trunc('day', start_time)
WHEN k = 1 THEN start_time WHEN k IN (0, 7, 9) THEN date_trunc('second', start_time) ELSE date_trunc('minute', start_time) END AS parsed FROM (SELECT event_id, start_time, event_id % 12 AS k FROM ev), as_of"""
)
def times_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's start in one of twelve ways to write it, read back."""
    at, kind = F.col("start_time"), F.col("event_id") % len(_FORMS)
    text = F.concat(F.lit("Starts "), F.coalesce(*(F.when(kind == k, F.date_format(at, form)) for k, form in enumerate(_FORMS))), F.lit(", tickets 25"))
    return b.events(spark, sf_dir).select("event_id", tx.flexible_time(text, b.as_of()).alias("parsed"))


# Stores by key and by place


@query("""SELECT coalesce(s.external_id, t.external_id) AS external_id, coalesce(s.provider, t.provider) AS provider, coalesce(s.name, t.name) AS name, CASE WHEN s.external_id IS NULL THEN t.avg_rating ELSE 5.0 END AS avg_rating, t.address
FROM (SELECT 'x' || venue_id AS external_id, provider, name, avg_rating, address FROM venues WHERE venue_id % 3 <> 0) t FULL JOIN (SELECT 'x' || venue_id AS external_id, provider, upper(name) AS name FROM venues WHERE venue_id % 2 = 0) s USING (external_id, provider)""")
def bucket_store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.venues(spark, sf_dir).select(F.concat(F.lit("x"), F.col("venue_id").cast("string")).alias("external_id"), "provider", "name", "avg_rating", "address", "venue_id")
    store = buckets.BucketStore(spark, f"{shared_dir(spark)}/civitas/store-{uuid.uuid4().hex}", ["external_id", "provider"], "external_id string, provider string, name string, avg_rating double, address string", 16)
    store.merge(v.where("venue_id % 3 <> 0").drop("venue_id"))
    store.merge(v.where("venue_id % 2 = 0").select("external_id", "provider", F.upper("name").alias("name"), F.lit(5.0).alias("avg_rating")), ["name", "avg_rating"])
    return store.read()


_SQL_AT = "38.9::DOUBLE + ((weather_id * 7919) % 4001) / 10000.0::DOUBLE AS lat, -94.8::DOUBLE + ((weather_id * 6007) % 4001) / 10000.0::DOUBLE AS lng"


@query(f"""SELECT weather_id, round(lat, 4) AS lat, round(lng, 4) AS lng, forecast_timestamp, temperature_f FROM (SELECT *, timestamp AS forecast_timestamp, {_SQL_AT} FROM weather), as_of
WHERE abs(lat - 39.1::DOUBLE) < 0.1::DOUBLE AND abs(lng - -94.6::DOUBLE) < 0.1::DOUBLE AND is_forecast AND forecast_timestamp BETWEEN now AND now + INTERVAL 24 HOUR""")
def weather_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = b._place("weather_id")
    placed = b.weather(spark, sf_dir).withColumns({"lat": lat, "lng": lng}).withColumnRenamed("timestamp", "forecast_timestamp")
    found = buckets.forecast(placed, 39.1, -94.6, b.as_of())
    return found.select("weather_id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "forecast_timestamp", "temperature_f")


@query("SELECT venue_id, round(lat, 4) AS lat, round(lng, 4) AS lng, name FROM venues WHERE lat > 39.05::DOUBLE - 0.05::DOUBLE AND lat < 39.05::DOUBLE + 0.05::DOUBLE AND lng > -94.65::DOUBLE - 0.05::DOUBLE AND lng < -94.65::DOUBLE + 0.05::DOUBLE")
def venues_of_a_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a table that is laid out by place."""
    at = f"{shared_dir(spark)}/civitas/places-{uuid.uuid4().hex}"
    buckets.save_by_place(b.venues(spark, sf_dir).where("lat IS NOT NULL AND lng IS NOT NULL").select("venue_id", "lat", "lng", "name"), at, 16)
    found = buckets.near(spark.read.parquet(at), 39.05, -94.65, 0.05)
    return found.select("venue_id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "name")


# Collection from searches


@query("""SELECT venue_id, arg_min(demo_id, (d, demo_id)) AS point_id, round(min(d), 2) AS distance FROM (SELECT venue_id, demo_id,
2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(d.lat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lng - v.lng) / 2), 2)))) AS d FROM venues v, demographics d) WHERE d <= 2500 GROUP BY venue_id""")
def nearest_search_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = b.demographics(spark, sf_dir).select(F.col("demo_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    found = geo.nearest_point(b.venues(spark, sf_dir), points, "venue_id", 2500.0)
    return found.select("venue_id", "point_id", F.round("distance", 2).alias("distance"))


@query("""SELECT 's' || (page_id // 6) AS search_id, 1 + page_id % 6 AS page, 'p' || page_id AS external_id, title AS name FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
WHERE page_id % 6 < 3 AND page_id % 30 <> 7 AND NOT (page_id % 30 = 8)""", bridged=False)
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as files: six pages a search, of which three are read; every fifth search's second page is broken, which ends it."""
    k, at = F.col("page_id"), f"{shared_dir(spark)}/civitas/answers-{uuid.uuid4().hex}"
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    token = lambda n: F.concat(F.lit("t"), n.cast("string"))
    body = F.to_json(F.struct(F.concat(F.lit("s"), F.floor(k / 6).cast("string")).alias("search_id"), F.when(k % 6 > 0, token(k)).alias("page_token"), token(k + 1).alias("next_page_token"), F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("place_id"), title.alias("name"))).alias("results")))
    rows = b.table(spark, sf_dir, "pages").select(F.when(k % 30 == 7, F.concat(F.lit("<oops>"), body)).otherwise(body).alias("value"))
    rows.write.text(at)
    answers = collect.answer_files(spark, at, lines=True)
    found = collect.search_pages(answers)
    return found.select("search_id", F.col("page").cast("long").alias("page"), F.explode("results").alias("p")).select("search_id", "page", F.col("p.place_id").alias("external_id"), "p.name")


@query("SELECT venue_id, provider, round(lat, 4) AS lat, round(lng, 4) AS lng FROM vf WHERE provider = 'p1' AND lat >= 39.0 AND lat <= 39.2 AND lng >= -94.7 AND lng <= -94.5 AND CAST(psychographic_relevance->>'$.fun' AS DOUBLE) >= 0.4".replace("FROM vf", "FROM (SELECT v.*, CASE WHEN venue_id % 4 <> 1 THEN '{\"fun\": 0.' || (venue_id % 10) || '}' END AS psychographic_relevance FROM venues v)"))
def venues_by_every_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"min_lat": 39.0, "max_lat": 39.2, "min_lng": -94.7, "max_lng": -94.5}
    found = reader.get_venues(b.venues_full(spark, sf_dir), {"provider": "p1", "bounds": bounds, "psychographic_min": 0.4})
    return found.select("venue_id", "provider", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


# The collection chain

_NAV = f"""nav AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_slice(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>'), 1, {pg.MOST_CARDS}) AS items FROM pages WHERE length(html) >= 500),
cards AS (SELECT page_id, host, i AS place, {_sql_plain(_TAGLESS.format('items[i]'))} AS title FROM nav, unnest(range(1, len(items) + 1)) t(i)),
stored AS (SELECT 'house_of_' || host || '_' || md5(title) AS external_id, 's_' || host AS provider, left(title, 200) AS name, page_id, place FROM cards WHERE length(title) >= {pg.LEAST_TITLE})"""


def _collected(spark: SparkSession, sf_dir: str):
    """The links of every page's menu as events of its host: half of the hosts' houses are known venues, by names in capitals."""
    pages = b.table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct()
    sources = hosts.select(F.concat(F.lit("s_"), "host").alias("source_name"), "host", F.concat(F.lit("House of "), "host").alias("venue_name"), F.lit("menu").alias("category"), F.lit(True).alias("is_enabled"), F.array(F.lit("nav li")).alias("selectors"))
    known = hosts.where("length(host) % 2 = 0").select(F.xxhash64("host").cast("string").alias("venue_id"), F.upper(F.concat(F.lit("House of "), "host")).alias("name"), F.lit(39.1).alias("lat"), F.lit(-94.6).alias("lng"), F.col("host").alias("address"))
    held = b.events_full(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.col("venue_id").cast("string").alias("venue_id"), "external_id", "provider", "name", "category", F.lit(None).cast("string").alias("subcategory"), "start_time", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("string").alias("address"), "created_at")
    return collect_events(pages, sources, held, known, b.as_of())


@full(
    f""", {_NAV} SELECT external_id, provider, name, category, NULL AS subcategory, start_time, NULL AS lat, NULL AS address, TIMESTAMP '2023-12-01' AS created_at FROM ef UNION ALL
SELECT external_id, provider, name, 'local_event', 'menu', NULL, CASE WHEN length(provider) % 2 = 0 THEN 39.1::DOUBLE END, CASE WHEN length(provider) % 2 = 0 THEN provider[3:] END, TIMESTAMP '2024-01-15' FROM stored GROUP BY ALL"""
)
def event_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, sf_dir).events.drop("event_id", "venue_id")


@query(f"WITH {_NAV}, host AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) SELECT 's_' || h AS source_name, count(name) > 0 AS success, count(name) AS records FROM host LEFT JOIN stored ON provider = 's_' || h GROUP BY h", bridged=False)
def event_collection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, sf_dir).runs.drop("ran_at")
