"""Pages as trees: selectors, event cards, Markdown. One small parser, in Arrow batches inside tasks.

A page is one list of starts, ends and texts in order, made with an open-tag stack over the tokens of ``html.parser``: an
end tag closes the nearest open element of its name, what stands open inside is closed with it, and one without a start is
passed over. The elements of a subtree are a range of the list, so nested elements stay whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
# Selectors of event cards, in the order in which they are tried, and those of a card's fields.
CARDS = (".event", ".event-item", ".event-card", "article.event", "li.event", ".show", ".performance", ".vevent", '[class*="event"]', '[class*="show"]', ".tribe-events-list-event-row")
TITLES = ("h1", "h2", "h3", "h4", ".title", ".event-title", ".name", ".event-name", "a")
DATES = (".date", ".event-date", "time", "[datetime]", ".start-date", ".when")
TIMES = (".time", ".event-time", ".start-time", ".when")
DESCRIPTIONS = (".description", ".event-description", "p", ".summary", ".excerpt")
PRICES = (".price", ".cost", ".ticket-price", "[class*='price']")
# Cards of a page, characters of a description, least characters of a title, and of a text that ends the search.
MOST_CARDS, MOST_TEXT, LEAST_TITLE, GOOD_TITLE, GOOD_TEXT = 50, 500, 3, 4, 11
# What a page loses before it is read, its longest Markdown, and what is put after a cut one, for events and for venues.
EVENT_PAGE = (("script", "style", "nav", "footer", "header", "iframe", "svg"), 12_000, "\n\n[Content truncated for processing...]")
VENUE_PAGE = (("script", "style", "nav", "footer", "header"), 15_000, "\n\n[Content truncated...]")


class Page(HTMLParser):
    """``events``: number of an element where it starts, its complement where it ends, strings for texts and None for comments. By
    element: tag, attributes, parent (-1: none), first and last event, start and end in the source, last element inside, whether an end tag of its own ends it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines = html, [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.events: list = []
        self.tags, self.attrs, self.parents, self.begin, self.end, self.start, self.stop, self.last, self.tagged = [], [], [], [], [], [], [], [], []
        self.open: list[int] = []
        self.standing: Counter = Counter()
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # markup that html.parser gives up on: what stands before it counts
            pass
        while self.open:
            self._shut(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, stop: int, tagged: bool = False) -> None:
        k = self.open.pop()
        self.tagged[k] = tagged
        self.events.append(~k)
        self.end[k], self.stop[k], self.last[k] = len(self.events), stop, len(self.tags) - 1
        self.standing[self.tags[k]] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        k, at = len(self.tags), self._at()
        self.tags.append(tag)
        own: dict = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        self.attrs.append(own)
        self.parents.append(self.open[-1] if self.open else -1)
        self.begin.append(len(self.events))
        self.end.append(0)
        self.start.append(at)
        self.stop.append(0)
        self.last.append(k)
        self.tagged.append(False)
        self.standing[tag] += 1
        self.events.append(k)
        self.open.append(k)
        if tag in VOID:
            self._shut(at + len(self.get_starttag_text()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut(self._at() + len(self.get_starttag_text()))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.standing[tag]:
            return
        at = self._at()
        while self.tags[self.open[-1]] != tag:
            self._shut(at)
        self._shut(self.html.find(">", at) + 1 or len(self.html), tagged=True)

    def handle_data(self, data: str) -> None:
        if self.events and isinstance(self.events[-1], str):
            self.events[-1] += data
        else:
            self.events.append(data)

    def handle_comment(self, data: str) -> None:
        self.events.append(None)

    def source(self, k: int) -> str:
        return self.html[self.start[k] : self.stop[k]]

    def text(self, k: int) -> str:
        """The texts inside an element, each trimmed, joined; those of scripts and styles inside it don't count."""
        out, hidden = [], []
        for e in self.events[self.begin[k] : self.end[k]]:
            if isinstance(e, str):
                if not hidden:
                    out.append(e.strip())
            elif e is not None:
                inner = e if e >= 0 else ~e
                if inner != k and self.tags[inner] in HIDDEN:
                    hidden.append(inner) if e >= 0 else hidden.pop()
        return "".join(out)

    def inside(self, k: int) -> range:
        """The elements inside one, in order."""
        return range(k + 1, self.last[k] + 1)

    def matches(self, k: int, steps: tuple, at: int = -1) -> bool:
        """Whether an element is what a compiled selector ends with, its ancestors being what stands before."""
        at %= len(steps)
        if not all(test(self.tags[k], self.attrs[k]) for test in steps[at][1]):
            return False
        if not at:
            return True
        k = self.parents[k]
        while k >= 0:
            if self.matches(k, steps, at - 1):
                return True
            if steps[at][0] == ">":
                return False
            k = self.parents[k]
        return False

    def select(self, selector: str, among: range | None = None) -> list[int]:
        """The elements, all or ``among`` these, that a selector finds, in order."""
        ways = compiled(selector)
        return [k for k in (range(len(self.tags)) if among is None else among) if any(self.matches(k, w) for w in ways)]

    def first(self, selector: str, among: range) -> int | None:
        ways = compiled(selector)
        return next((k for k in among if any(self.matches(k, w) for w in ways)), None)


PART = re.compile(r"""\s*(?:(?P<comma>,)|(?P<child>>)|(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[\w-]+))\s*)?\])""")
HOLDS = {"=": str.__eq__, "*=": lambda have, want: bool(want) and want in have, "^=": lambda have, want: bool(want) and have.startswith(want), "$=": lambda have, want: bool(want) and have.endswith(want), "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(want + "-")}


@functools.lru_cache(1000)
def compiled(selector: str) -> tuple:
    """Each alternative as steps (how it follows the step before: "", " " or ">", tests of tag and attributes)."""
    ways, steps, follows, at = [], [], "", 0
    while at < len(selector.rstrip()):
        m = PART.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector}")
        spaced, kind = m[0][:1].isspace(), m.lastgroup
        if m["comma"]:
            ways.append(tuple(steps))
            steps, follows = [], ""
        elif m["child"]:
            follows = ">"
        else:
            if not steps or follows == ">" or spaced:
                steps.append((follows or (" " if steps else ""), []))
                follows = ""
            tests = steps[-1][1]
            if m["tag"]:
                tag = m["tag"].lower()
                tests.append(lambda have, attrs, tag=tag: tag in ("*", have))
            elif m["cls"]:
                tests.append(lambda have, attrs, cls=m["cls"]: cls in attrs.get("class", "").split())
            elif m["id"]:
                tests.append(lambda have, attrs, own=m["id"]: attrs.get("id") == own)
            else:
                name, op, want = m["attr"].lower(), m["op"], next((x for x in (m["a"], m["b"], m["c"]) if x is not None), None)
                tests.append(lambda have, attrs, name=name, op=op, want=want: name in attrs and (op is None or HOLDS[op](" ".join(attrs[name].split()) if name == "class" else attrs[name], want)))
        at = m.end()
    ways.append(tuple(steps))
    if not all(ways) or follows:
        raise ValueError(f"not a selector: {selector}")
    return tuple(ways)


def absolute(link: str | None, url: str | None) -> str | None:
    """A link made absolute against the scheme and host of its page's URL."""
    if not link or re.match("https?:", link):
        return link
    root = re.match("(https?:)//[^/]+", url or "")
    if link.startswith("//"):
        return (root[1] if root else "https:") + link
    return (root[0] if root else "") + ("" if link.startswith("/") else "/") + link


def card(page: Page, k: int, url: str | None) -> tuple | None:
    """(title, date, time, description, url, price, image_url) of a card; None without a title. Of a field's selectors each
    takes the place of the one before until one gives enough."""
    among = page.inside(k)

    def field(selectors: tuple[str, ...], read, enough: int = 1) -> str | None:
        found = None
        for s in selectors:
            at = page.first(s, among)
            if at is not None:
                found = read(at)
                if len(found or "") >= enough:
                    break
        return found

    title = field(TITLES, page.text, GOOD_TITLE)
    if len(title or "") < LEAST_TITLE:
        return None
    date = field(DATES, lambda at: page.text(at) or page.attrs[at].get("datetime"))
    text = field(DESCRIPTIONS, lambda at: t[:MOST_TEXT] if len(t := page.text(at)) >= GOOD_TEXT else None)
    link, image = page.first("a[href]", among), page.first("img[src]", among)
    return (title, date or None, field(TIMES, page.text) or None, text, absolute(page.attrs[link]["href"], url) if link is not None else None, field(PRICES, page.text) or None, absolute(page.attrs[image]["src"], url) if image is not None else None)


FIELDS = ("title", "date", "time", "description", "url", "price", "image_url")


def event_cards(pages: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """(page_id, place, title, date, time, description, url, price, image_url): the cards with a title of ``pages``
    (page_id, url, html, and where a source has its own, selectors: an array), found by the first selector that finds any, up to ``most``.

    A null or empty page has none; a null list of selectors is ``CARDS``. Cards may hold other cards; each is read whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for at, (url, html, selectors) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                page = Page(html or "")
                found = next((f for s in (CARDS if selectors is None else selectors) if (f := page.select(s))), [])
                each = [(place, *fields) for place, k in enumerate(found[:most]) if (fields := card(page, k, url))]
                rows += each
                of += [at] * len(each)
            columns = list(zip(*rows)) or [()] * 8
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], ["page_id", "place", *FIELDS])

    own = F.col("selectors") if "selectors" in pages.columns else F.lit(None).cast("array<string>").alias("selectors")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", own).mapInArrow(read, f"page_id {kind}, place int, " + ", ".join(f"{f} string" for f in FIELDS))


def blocks(pages: DataFrame, selectors: list[str], most: int = 20) -> DataFrame:
    """(page_id, place, block): the source of the elements that the first of ``selectors`` with any finds, up to ``most`` a page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, html in enumerate(batch.column(1).to_pylist()):
                page = Page(html or "")
                found = next((f for s in selectors if (f := page.select(s))), [])
                out += [(at, place, page.source(k)) for place, k in enumerate(found[:most])]
            of, place, block = list(zip(*out)) or [()] * 3
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), pa.array(place, pa.int32()), pa.array(block, pa.string())], ["page_id", "place", "block"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(read, f"page_id {kind}, place int, block string")


#: Elements that stand in paragraphs of their own.
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul title".split())


def markdown(html: str | None, dropped: tuple[str, ...] = EVENT_PAGE[0], most: int = EVENT_PAGE[1], cut: str = EVENT_PAGE[2]) -> str | None:
    """A page as Markdown: headings, lists (nested ones indented), links, images, rules, emphasis, quotes and paragraphs, without the
    ``dropped`` elements, comments and scripts; what is longer than ``most`` characters ends there with ``cut``."""
    if html is None:
        return None
    page, gone = Page(html), HIDDEN | set(dropped)
    lines: list[str] = []
    now: list = []  # texts, and (element, mark) of emphasis, which counts where it begins and ends in one block
    lists: list[list] = []  # tag and number of each list that is open
    quotes, skipped, begun, head = 0, 0, "", ""

    def flush() -> None:
        nonlocal head
        pairs = Counter(x for x in now if isinstance(x, tuple))
        whole = "".join(x if isinstance(x, str) else x[1] * (pairs[x] == 2) for x in now)
        text = "\n".join(s for part in whole.split("\0") if (s := re.sub(r"[ \t\r\n\f]+", " ", part).strip()))
        now.clear()
        if text:
            before = "> " * quotes
            rest = " " * len(head) if head.strip()[:1] in "*0123456789" else ""
            lines.append(before + head + text.replace("\n", "  \n" + before + rest))
            head = ""

    for e in page.events:
        if e is None:
            continue
        if isinstance(e, str):
            if not skipped:
                now.append(e.replace("\0", ""))
            continue
        k, opens = (e, True) if e >= 0 else (~e, False)
        tag, attrs = page.tags[k], page.attrs[k]
        if tag in gone:
            skipped += 1 if opens else -1
        if skipped or tag in gone:
            continue
        if tag in BLOCKS:
            flush()
            if not opens and tag == "li":
                head = ""
        if tag in ("ul", "ol"):
            lists.append([tag, 0]) if opens else lists.pop()
        elif tag == "blockquote":
            quotes += 1 if opens else -1
        elif tag == "li" and opens:
            kind = lists[-1] if lists else ["ul", 0]
            kind[1] += 1
            head = "  " * max(len(lists) - 1, 0) + ("* " if kind[0] == "ul" else f"{kind[1]}. ")
        elif re.fullmatch("h[1-6]", tag):
            head = "#" * int(tag[1]) + " " if opens else ""
        elif tag == "hr" and opens:
            lines.append("* * *")
        elif tag == "br" and opens:
            now.append("\0")
        elif tag in ("b", "strong", "i", "em") and page.tagged[k]:
            now.append((k, "**" if tag in ("b", "strong") else "_"))
        elif tag == "img" and opens and attrs.get("src"):
            now.append(f"![{attrs.get('alt', '')}]({attrs['src']})")
        elif tag == "a" and attrs.get("href"):
            now.append("[" if opens else f"]({attrs['href']})")
    flush()
    item = [bool(re.match(r"(?:> )*\s*(?:\* (?!\*)|\d+\. )", x)) for x in lines]
    out = "".join(x + ("" if at + 1 == len(lines) else "\n" if item[at] and item[at + 1] else "\n\n") for at, x in enumerate(lines))
    return out if len(out) <= most else out[:most] + cut


def as_markdown(pages: DataFrame, kind: tuple = EVENT_PAGE) -> DataFrame:
    """(page_id, markdown) of ``pages`` (page_id, html): as event pages or venue pages are read. A null page stays null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([markdown(h, *kind) for h in batch.column(1).to_pylist()], pa.string())], ["page_id", "markdown"])

    of = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(read, f"page_id {of}, markdown string")
