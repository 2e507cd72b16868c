"""Collection as data: answers and pages of registered sources to rows, totals and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.functions import scoring, text
from civitas.operators.store import latest, slug

PLACES = "struct<results:array<struct<place_id:string,name:string,vicinity:string,rating:double,types:array<string>,geometry:struct<location:struct<lat:double,lng:double>>>>>"
#: Characters of a page under which it isn't read.
LEAST = 500


def places(answers: DataFrame) -> DataFrame:
    """Venue rows of ``answers`` (answer: JSON of a places search): one for each place_id, of those that several
    searches found the one that sorts first. Answers that don't parse give none."""
    return place_rows(answers.select(F.from_json("answer", PLACES)["results"].alias("results")))


def place_rows(found: DataFrame) -> DataFrame:
    """``places`` of parsed answers (results)."""
    each = found.select(F.explode("results").alias("p")).where("p.place_id IS NOT NULL")
    name = F.coalesce("p.name", F.lit("Unknown Venue"))
    rows = each.select(
        F.col("p.place_id").alias("external_id"), F.lit("google_places").alias("provider"), name.alias("name"), scoring.type_category(F.coalesce("p.types", F.array().cast("array<string>"))).alias("category"),
        F.try_element_at("p.types", F.lit(1)).alias("subcategory"), F.coalesce("p.vicinity", F.lit("")).alias("address"), F.col("p.geometry.location.lat").alias("lat"), F.col("p.geometry.location.lng").alias("lng"), F.col("p.rating").alias("avg_rating"),
    )
    return latest(rows, ["external_id"], [F.col(c) for c in ("name", "address", "category", "subcategory", "lat", "lng", "avg_rating")])


#: An answer's file: what was searched, the page asked for, the next page's token, its results, and the text of what doesn't parse.
ANSWER = f"search_id string, page_token string, next_page_token string, {PLACES[7:-1].replace('results:', 'results ', 1)}, _corrupt_record string"
# Fixed value: pages of a search.
MOST_PAGES = 3


def answer_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, search_id, page_token, next_page_token, results, problem) of the JSON files under ``path``, one object each or (``lines``) one a line: the text
    of an object that doesn't parse, or the lack of a search, is its problem; every one has a row."""
    rows = spark.read.schema(ANSWER).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    problem = F.coalesce("_corrupt_record", F.when(F.col("search_id").isNull(), "no search_id"))
    return rows.select(F.col("_metadata.file_name").alias("file"), "search_id", "page_token", "next_page_token", "results", problem.alias("problem"))


def search_pages(answers: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(search_id, page, results) of good ``answers``: the first page of each search, and those that the token of the page before leads to, up to ``most``."""
    good = answers.where("problem IS NULL").select("search_id", "page_token", "next_page_token", "results")
    now = good.where("page_token IS NULL").select("search_id", "next_page_token", "results", F.lit(1).alias("page"))
    every = now.select("search_id", "page", "results")
    for page in range(2, most + 1):
        asked = now.where("next_page_token IS NOT NULL").select("search_id", F.col("next_page_token").alias("page_token")).distinct()
        now = good.join(asked, ["search_id", "page_token"]).select("search_id", "next_page_token", "results", F.lit(page).alias("page"))
        every = every.unionByName(now.select("search_id", "page", "results"))
    return every


def page_venues(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """A venue row for each acceptable page (page_id, url, html) of a registered source (source_name, host,
    category, is_enabled): its title as the name, its meta description or first paragraph, an id that
    follows from source and name. Spark broadcasts the sources where they are few enough; else a host with many pages is split by its skew join."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    own = pages.where(text.acceptable(F.col("html"), LEAST)).withColumn("host", host)
    rows = own.join(sources.where("is_enabled"), "host").withColumn("name", text.page_title(F.col("html"))).where("name <> ''")
    rows = rows.select(F.concat_ws("_", "source_name", slug(F.col("name"))).alias("external_id"), F.col("source_name").alias("provider"), "name", text.meta_description(F.col("html")).alias("description"), "category", F.col("url").alias("website"), "page_id")
    return latest(rows, ["external_id", "provider"], [F.col("page_id")])


def totals(*rows: DataFrame) -> DataFrame:
    """(provider, records, with_location) over rows of several collections."""
    need = ("provider", "lat", "lng")
    each = [r.select(*(F.col(c) if c in r.columns else F.lit(None).cast("double").alias(c) for c in need)) for r in rows]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return every.groupBy("provider").agg(F.count("*").alias("records"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("with_location"))


def with_fallback(rows: DataFrame, fallback: DataFrame, source: str = "provider") -> DataFrame:
    """``rows``, and of ``fallback`` the rows of sources that have none there."""
    return rows.unionByName(fallback.join(rows.select(source).distinct(), source, "left_anti"), allowMissingColumns=True)


def runs_of(sources: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """A run for each enabled source: how many rows it gave; none is a failure."""
    found = rows.groupBy(F.col("provider").alias("source_name")).agg(F.count("*").alias("records"))
    both = sources.where("is_enabled").select("source_name").join(found, "source_name", "left")
    return both.select("source_name", at.alias("ran_at"), F.col("records").isNotNull().alias("success"), F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def event_fields(blocks: DataFrame) -> DataFrame:
    """(page_id, place, title, date, link) of blocks (page_id, place, block) that have a heading or a link's text."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    block = F.col("block")
    title = plain(F.coalesce(F.nullif(F.regexp_extract(block, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), F.lit("")), F.regexp_extract(block, r"(?is)<a\b[^>]*>(.*?)</a>", 1)))
    date = F.coalesce(F.nullif(F.regexp_extract(block, r"""(?is)<time[^>]*datetime=["']([^"']*)["']""", 1), F.lit("")), F.nullif(F.regexp_extract(block, r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1), F.lit("")))
    link = F.nullif(F.regexp_extract(block, r"""(?is)<a\b[^>]*href=["']([^"']*)["']""", 1), F.lit(""))
    return blocks.select("page_id", "place", title.alias("title"), date.alias("date"), link.alias("link")).where("title <> ''")


def venue_of_answer(answer: Column) -> Column:
    """The venue object of a model's answer, fences and prose around it aside: (name, category, description,
    address, phone, website, rating); null where there is none or it has no name."""
    kind = "struct<name:string,category:string,description:string,address:string,phone:string,website:string,rating:string>"
    inner = F.regexp_extract(F.regexp_replace(answer, r"(?i)```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(inner, r",\s*([\]}])", "$1")
    tried = [F.from_json(F.nullif(x, F.lit("")), kind) for x in (inner, mended)]
    made = F.when(tried[0]["name"].isNotNull(), tried[0]).otherwise(tried[1])
    found = F.struct(*(made[k].alias(k) for k in ("name", "category", "description", "address", "phone", "website")), made["rating"].try_cast("double").alias("rating"))
    return F.when(F.trim(made["name"]) != "", found)
