"""Pages, JSON answers and dates as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.operators.pages import blocks

DROPPED = ("script", "style", "nav", "footer", "header", "iframe", "svg")
EVENT = "array<struct<title:string,date:string,time:string,location:string,description:string,url:string,price:string>>"
def strip_html(html: Column, most: int = 15_000) -> Column:
    """A page's text without the dropped blocks, tags and extra white space, up to ``most`` characters."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " ")), 1, most)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_description(html: Column) -> Column:
    """The description of a page's meta tags, else its first paragraph; null where it has neither."""
    meta = F.regexp_extract(html, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1)
    first = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<p[^>]*>(.*?)</p>", 1), r"(?s)<[^>]*>", " "))
    return F.coalesce(F.nullif(F.trim(meta), F.lit("")), F.nullif(first, F.lit("")))


def acceptable(html: Column, least: int = 500) -> Column:
    return F.coalesce(F.char_length(html) >= least, F.lit(False))


def json_array(answer: Column) -> Column:
    """The JSON array inside an answer: without fences, from the first bracket to the last."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"(?i)```(?:json)?", ""), r"^\s*json\s*", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\[.*\])", 1), F.lit(""))


#: A double-quoted and a single-quoted literal: it ends at the quote that something which can follow a value or key follows,
#: so quotes inside are no end. Possessive, as Java's matcher would otherwise recur for each character.
_DOUBLE = r'"[^"\\]*+(?:(?:\\.|"(?!\s*(?:[,:}\]]|$)))[^"\\]*+)*+"'
_SINGLE = r"'[^'\\]*+(?:(?:\\.|'(?!\s*(?:[,:}\]]|$)))[^'\\]*+)*+'"
_TOKEN = rf"""(?s){_DOUBLE}|{_SINGLE}|[^"']++|."""
#: An object, with objects in it one deep, and no brace of a literal counted.
_OBJECT = rf"""(?s)\{{(?:[^{{}}"']++|{_DOUBLE}|{_SINGLE}|\{{(?:[^{{}}"']++|{_DOUBLE}|{_SINGLE})*+\}})*+\}}"""


def mended_json(s: Column) -> Column:
    """JSON without trailing commas, and with double quotes around single-quoted keys and values.

    The text is cut into literals and what stands between them. Commas are only taken away between literals, whatever a
    value holds; quotes inside a literal are escaped as JSON wants them.
    """

    def mend(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.char_length(token) - 2)
        # each escape or bare quote of a literal: an escaped apostrophe is one, a bare double quote gets its backslash
        escaped = F.regexp_replace(F.regexp_replace(inner, r"((?<!\\)(?:\\\\)*+)\\'", "$1'"), r'((?<!\\)(?:\\\\)*+)"', r'$1\\"')
        literal = F.concat(F.lit('"'), escaped, F.lit('"'))
        whole = (F.char_length(token) > 1) & token.rlike(r"""(?s)^(["']).*\1$""")
        return F.when(whole, literal).otherwise(F.regexp_replace(token, r",\s*(?=[\]}])", ""))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)), mend), "")


def parse_events(answer: Column, most: int = 50) -> Column:
    """Events of an answer: strictly parsed, else mended (``mended_json``), else object by object, each mended,
    where there is a title; the first ``most`` with a title. None: an empty array."""
    s = json_array(answer)
    strict = {"allowSingleQuotes": "false"}
    objects = F.regexp_extract_all(answer, F.lit(_OBJECT), F.lit(0))
    each = F.array_compact(F.transform(objects, lambda o: F.from_json(mended_json(o), EVENT[6:-1])))
    found = F.coalesce(F.from_json(s, EVENT, strict), F.from_json(mended_json(s), EVENT, strict), each, F.expr(f"cast(array() as {EVENT})"))
    return F.slice(F.filter(found, lambda e: e["title"].isNotNull() & (F.trim(e["title"]) != "")), 1, most)


# Names of months and weekdays, of which the first three letters are enough.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _named(names: tuple[str, ...], also: str = "") -> str:
    return "(" + "|".join(f"{n[:3]}(?:{n[3:]})?" if n[3:] else n for n in names) + also + ")"


_MONTH, _DAY, _YEAR = _named(MONTHS, "|sept") + r"\b\.?", r"(\d{1,2})(?:st|nd|rd|th)?", r"(?:,?\s+|\s*,\s*|[-/])(?:(\d{4})\b(?!:)|'(\d{2})\b)"
#: Ways to write a date, with the places of year, month and day among the groups (0: none); the first that is there counts.
_DATES = (
    (r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", (1, 2, 3)),
    (r"(?<![\d/.-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?![\d/.-]*\d)", (4, 1, 3)),
    (rf"\b{_MONTH}[\s-]*{_DAY}(?![\d:])(?!\s*[ap]\.?m\b)(?:{_YEAR})?", (3, 1, 2)),
    (rf"(?<![\d:]){_DAY}\.?(?:\s+of)?[\s-]*{_MONTH}(?:{_YEAR})?", (3, 2, 1)),
    (rf"\b{_MONTH}(?:{_YEAR})", (2, 1, 0)),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?:t(?=\d)|(?!\d))", (1, 2, 3)),
    (r"(?<![\d/.])(\d{1,2})/(\d{1,2})(?![\d/])", (0, 1, 2)),
)
_WEEKDAY = rf"\b{_named(WEEKDAYS, '|tues|thur|thurs')}\b"
_CLOCK, _HOUR, _PACKED = r"(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?!\d)(?:\s*([ap])\b\.?(?:m\b)?|\s*([ap])m\b)?", r"(?<![\d:/.-])(\d{1,2})\s*([ap])\.?m\b", r"(?<!\d)\d{8}t?(\d{2})(\d{2})(\d{2})?(?!\d)"


def flexible_time(text: Column, now: Column) -> Column:
    """The date and time that a text names somewhere, as a timestamp without zone; null where it names neither.

    Dates: year-month-day, month/day/year (day first where the first number is no month; years of two digits lie within 50 of now's), a
    month by name before or after its day, with or without a year, a month and a year, eight digits. A weekday without a date is
    the next such day from ``now`` on. What a text leaves out is that of ``now``, the time midnight. Clocks: 19:30, 19:30:15.5, 7:30 pm, 7 p.m., 7pm. A
    date that there isn't (February 30) is null.
    """
    today = now.cast("timestamp_ntz").cast("date")
    return _let(F.lower(text), lambda low: _let(_date_parts(low), lambda d: _let(_clock_parts(low), lambda c: _made(low, d, c, today))))


def _let(value: Column, of) -> Column:
    """``of`` the value, which stands in the plan once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _got(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) if k else F.lit(None).cast("string")


def _date_parts(low: Column) -> Column:
    """(way, y, y2, m, d): the number of the first of ``_DATES`` that a text has, and its parts as they stand there; null without any."""
    ways = []
    for way, (pattern, (year, month, day)) in enumerate(_DATES):
        short = year + 1 if "'" in pattern else 0
        parts = F.struct(F.lit(way).alias("way"), _got(low, pattern, year).alias("y"), _got(low, pattern, short).alias("y2"), _got(low, pattern, month).alias("m"), _got(low, pattern, day).alias("d"))
        ways.append(F.when(low.rlike(pattern), parts))
    return F.coalesce(*ways)


def _clock_parts(low: Column) -> Column:
    """(h, m, s, f, half): the parts of a text's clock as they stand there; null without any."""
    kinds = ((_CLOCK, (1, 2, 3, 4)), (_HOUR, (1, 0, 0, 0)), (_PACKED, (1, 2, 3, 0)))
    halves = (F.coalesce(_got(low, _CLOCK, 5), _got(low, _CLOCK, 6)), _got(low, _HOUR, 2), F.lit(None).cast("string"))
    return F.coalesce(*(F.when(low.rlike(p), F.struct(*(_got(low, p, k).alias(n) for k, n in zip(at, "hmsf")), half.alias("half"))) for (p, at), half in zip(kinds, halves)))


def _made(low: Column, d: Column, c: Column, today: Column) -> Column:
    """The timestamp of a text's parts of a date and a clock."""
    whole = lambda x: x.try_cast("int")
    named = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(d["m"], 1, 3)).cast("int")
    first, second = F.coalesce(F.nullif(named, F.lit(0)), whole(d["m"])), whole(d["d"])
    swapped = (d["way"] == 1) & (first > 12)  # numbers: the first is the day where it is no month
    century, this = F.floor(F.year(today) / 100).cast("int") * 100, F.year(today)
    near = lambda y: F.when(y + century >= this + 50, y + century - 100).when(y + century < this - 50, y + century + 100).otherwise(y + century)
    short = F.coalesce(d["y2"], F.when(F.char_length(d["y"]) <= 2, d["y"]))
    year = F.coalesce(near(whole(short)), whole(d["y"]), this)
    month = F.when(swapped, second).otherwise(first)
    date = lambda day: F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")
    # a month without a day has at most as many days as it has
    day = F.when(d["way"] == 4, F.least(F.dayofmonth(today), F.dayofmonth(F.last_day(date(F.lit(1)))))).when(swapped, first).otherwise(second)
    weekday = F.array_position(F.array(*(F.lit(w[:3]) for w in WEEKDAYS)), F.substring(F.regexp_extract(low, _WEEKDAY, 1), 1, 3)).cast("int")
    ahead = F.date_add(today, F.pmod(weekday - 1 - F.weekday(today), F.lit(7)))
    found = F.when(d.isNotNull(), date(day)).when(weekday > 0, ahead).when(c.isNotNull(), today)
    hour, minute, sec = (F.coalesce(whole(c[k]), F.lit(0)) for k in "hms")
    hour = F.when(c["half"] == "p", hour % 12 + 12).when(c["half"] == "a", hour % 12).otherwise(hour)
    micros = F.rpad(F.coalesce(c["f"], F.lit("0")), 6, "0").cast("long")
    valid = (hour < 24) & (minute < 60) & (sec < 60)
    at = F.make_dt_interval(secs=((hour * 3600 + minute * 60 + sec) + micros / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.when(valid, found.cast("timestamp_ntz") + at)


def parse_time(day: Column, time: Column, now: Column | None = None) -> Column:
    """The timestamp that a day and a time name together (``flexible_time``), the day's own time or midnight where the time says
    none; null where the day is null or names no date."""
    now = F.current_timestamp() if now is None else now
    both = lambda d, t: F.when(t.isNull(), d).otherwise(F.date_trunc("day", d).cast("timestamp_ntz") + (t - F.date_trunc("day", t).cast("timestamp_ntz")))
    clocked = F.when(F.lower(time).rlike(f"{_CLOCK}|{_HOUR}"), time)
    return _let(flexible_time(day, now), lambda d: _let(flexible_time(clocked, now), lambda t: both(d, t))).cast("timestamp")


def fuzzy_time(text: Column, now: Column) -> Column:
    """``flexible_time`` of a text that names a date; a clock without one is none."""
    dated = lambda low: _date_parts(low).isNotNull() | low.rlike(_WEEKDAY)
    return F.when(_let(F.lower(text), dated), flexible_time(text, now))


def absolute_url(href: Column, page: Column) -> Column:
    """A link made absolute against the page's scheme and host."""
    root = F.regexp_extract(page, r"^(https?://[^/]+)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def first_blocks(pages: DataFrame, selectors: list[tuple[str, str]], most: int = 20) -> DataFrame:
    """(page_id, place, block): blocks, whole, of the first selector (tag, class) that a page has, up to ``most``."""
    return blocks(pages, [f"{tag}.{cls}" for tag, cls in selectors], most)
