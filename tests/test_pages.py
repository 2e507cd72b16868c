"""Pages as trees, against trees that the test builds itself."""

import random

import pytest

from civitas.operators import pages as pg

WORDS = "jazz blues night open hall & < stage river".split()


class Element:
    """An element of a made-up page, its HTML, its text and its descendants."""

    def __init__(self, rng, depth, parent=None):
        self.parent, self.tag = parent, rng.choice(["div", "span", "section", "h3", "article", "em"])
        self.classes = [c for c in ("event", "card", "title", "event-row") if rng.random() < 0.25]
        self.attrs = {"data-k": rng.choice(["one", "two-x", "x two"])} if rng.random() < 0.4 else {}
        self.children = []
        for _ in range(rng.randrange(4) if depth else 0):
            self.children.append(" ".join(rng.choice(WORDS) for _ in range(2)) if rng.random() < 0.4 else Element(rng, depth - 1, self))

    def html(self):
        own = "".join(f' {k}="{v}"' for k, v in ({"class": " ".join(self.classes)} if self.classes else {} | self.attrs).items())
        inner = "".join(c.html() if isinstance(c, Element) else c.replace("&", "&amp;").replace("<", "&lt;") + "<!-- c -->" for c in self.children)
        return f"<{self.tag}{own}>{inner}</{self.tag}>"

    def text(self):
        return "".join(c.text() if isinstance(c, Element) else c.strip() for c in self.children)

    def every(self):
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.every()

    def above(self):
        k = self.parent
        while k:
            yield k
            k = k.parent


RULES = {
    "div": lambda e: e.tag == "div",
    ".event": lambda e: "event" in e.classes,
    "div.event.card": lambda e: e.tag == "div" and {"event", "card"} <= set(e.classes),
    '[class*="event"]': lambda e: "event" in " ".join(e.classes),
    "h3, .title": lambda e: e.tag == "h3" or "title" in e.classes,
    ".event h3": lambda e: e.tag == "h3" and any("event" in a.classes for a in e.above()),
    "article>span": lambda e: e.tag == "span" and e.parent is not None and e.parent.tag == "article",
    "section .card > *": lambda e: e.parent is not None and "card" in e.parent.classes and any(a.tag == "section" for a in e.parent.above()),
    ".event .card em": lambda e: e.tag == "em" and any("card" in a.classes and any("event" in x.classes for x in a.above()) for a in e.above()),
    "[class]": lambda e: bool(e.classes),
}


@pytest.mark.parametrize("seed", range(30))
def test_selectors_on_random_trees(seed):
    root = Element(random.Random(seed), 6)
    page, every = pg.Page(root.html()), list(root.every())
    assert [(page.tags[k], page.text(k), page.source(k)) for k in range(len(every))] == [(e.tag, e.text(), e.html()) for e in every]
    for selector, rule in RULES.items():
        assert page.select(selector) == [k for k, e in enumerate(every) if rule(e)], selector


@pytest.mark.parametrize("selector,found", [("[data-k=one]", [0]), ("[data-k='two-x']", [1]), ('[data-k^="two"]', [1]), ('[data-k$="two"]', [2]), ("[data-k~=two]", [2]), ("[data-k|=two]", [1]), ("[data-k]", [0, 1, 2]), ("#z", [3]), ("I#z", [3])])
def test_attributes(selector, found):
    assert pg.Page('<i data-k="one"></i><i data-k="two-x"></i><i data-k="x two"></i><i id=z></i>').select(selector) == found


@pytest.mark.parametrize("selector", ["", ">", "a >", "a,,b", "a:hover", ".", "[x", ", a"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        pg.compiled(selector)


def test_broken_markup():
    page = pg.Page("<ul><li class=event>one<li class=event>two</ul></div><p>a<p>b</p>c<br>d<script>var x = '<p class=event>';</script><img src=x>")
    assert [page.text(k) for k in page.select("li")] == ["onetwo", "two"] and page.text(page.select("p")[0]) == "abcd" and len(page.select(".event")) == 2
    for html in ("", "<", "<![if x]>", "<p", "</p>", "<a href='x", "&#xZZ; &bogus;", "<!--", "<" * 5000, "<div>" * 3000, "<p>" * 2000 + "</b>" * 2000):
        pg.Page(html)
        pg.markdown(html)


CARD = """<div class="event card"><div class="inner"><h2>ab</h2><span class="title">Jazz &amp; <b>Blues</b></span></div><time datetime="2025-12-15T19:30"></time><span class="event-time"> 7:30 PM </span>
<p>too short</p><div class="summary">A long and fine description.</div><a href="/e/1">more</a><img alt="x"><img src="//cdn.org/i.png"><b class="my-price-tag">$25</b></div>"""


def test_cards(spark):
    nested = '<div class="event"><div class="event"><h3>Inner show</h3></div><h1>Outer night</h1></div>'
    own = "<ul class=gigs><li><a href='https://x.org/1'>First gig</a></li><li>no</li><li><a href='g/2'>Gig two</a><span class=date>Dec 5</span></li></ul>" + CARD
    rows = [(1, "https://h.org/a/b", CARD, None), (2, "https://h.org/", nested, None), (3, "https://g.org", own, [".none", "ul.gigs > li"]), (4, None, None, None), (5, "u", "<p>nothing</p>", []), (6, None, "<article class=event><h3>No page URL</h3><a href='x'>y</a></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, selectors array<string>")
    found = [tuple(r) for r in pg.event_cards(df).orderBy("page_id", "place").collect()]
    assert found == [
        (1, 0, "Jazz &Blues", "2025-12-15T19:30", "7:30 PM", "A long and fine description.", "https://h.org/e/1", "$25", "https://cdn.org/i.png"),
        (2, 0, "Outer night", None, None, None, None, None, None), (2, 1, "Inner show", None, None, None, None, None, None),
        (3, 0, "First gig", None, None, None, "https://x.org/1", None, None), (3, 2, "Gig two", "Dec 5", None, None, "https://g.org/g/2", None, None),
        (6, 0, "No page URL", None, None, None, "/x", None, None),
    ]
    assert pg.event_cards(df.where("false")).count() == 0
    many = spark.createDataFrame([(1, "u", "<li class=event><b class=name>Show</b></li>" * 70)], "page_id long, url string, html string")
    assert pg.event_cards(many).count() == pg.MOST_CARDS


def test_blocks_are_whole(spark):
    html = 'x<div class="event card"><div class="inner"><h3>Jazz</h3></div><time datetime="2025">t</time><a href="/x">y</a></div >z'
    (row,) = pg.blocks(spark.createDataFrame([(1, html)], "page_id long, html string"), [".none", "div.event"]).collect()
    assert row.block == html[1:-1]


def test_markdown(spark):
    html = """<title>Home</title><style>p{}</style><nav>n</nav><h1>The  hall</h1><p>Open <b>late</b>, <em>always</em>: <a href="/x">see\n here</a><br>new line</p><ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul>
<ol><li>a<li>b</ol><hr><blockquote><p>said<br>so</p></blockquote><img src=i.png alt=pic><p><b>never closed<p>1 &lt; 2<!-- gone --></p>tail"""
    expected = "Home\n\n# The hall\n\nOpen **late**, _always_: [see here](/x)  \nnew line\n\n* one\n  * deep\n* two\n1. a\n2. b\n\n* * *\n\n> said  \n> so\n\n![pic](i.png)\n\nnever closed\n\n1 < 2\n\ntail"
    assert pg.markdown(html) == expected
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>" + "word " * 5000)], "page_id long, html string")
    rows = {r.page_id: r.markdown for r in pg.as_markdown(df, pg.VENUE_PAGE).collect()}
    assert rows[1] == expected and rows[2] is None and rows[3] == "" and rows[4] == ("word " * 5000)[:15_000] + pg.VENUE_PAGE[2]
