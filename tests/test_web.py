"""Anchors against the standard library's parser, robots texts against its robots parser, on awkward input."""

import random
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pytest

from lithic.sources import allowed, anchors, html, robots
from lithic.sources.fetch import robots_bodies


# ------------------------------------------------------------------ html
class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.found.append((dict(attrs)["href"] or "").strip())


def test_links_equal_a_plain_parser():
    rng = random.Random(4)
    bits = [
        "<a href=/x>", "<a href='/y?a=1&amp;b'>", '<A class="a > b" HREF = "/z">', "</a>", "<a name=q>", "<!-- <a href=/no> -->", "<script>'<a href=/no>'</script>", "<style>a{}</style>", "text", "<br/>", "<a href>",
        "<a href=''>", "<abbr href=/no>", "<p title='it is'>", "<a data-href=/no href=/yes>", "<a\n\thref=/line\n>", "<b>", "&lt;a href=/no&gt;", "<a href=/1 href=/2>", "<a/href=/slash>", "<area href=/no>",
    ]
    for _ in range(300):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        p = Plain()
        p.feed(page)
        p.close()
        assert [h for h, _ in html.links(page)[1]] == p.found, page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("<a href=/x", [("/x", "")]), ("<a href='/x", [("/x", "")]), ("<!-- <a href=/x>", []), ("<script><a href=/x>", []), ("<a href=/x>a <b>b</b>&amp;<!-- c --> d\n e</a> f", [("/x", "a b & d e")]),
        ("<a href=/x>one<a href=/y>two", [("/x", "one"), ("/y", "two")]), ("<a title=it's href=/x>t</a>", [("/x", "t")]), ("<scripty><a href=/x></scripty>", [("/x", "")]),
    ],
)
def test_broken_pages(page, want):
    assert html.links(page)[1] == want


def test_long_broken_pages_take_linear_time():
    for page in ("<a " * 300_000, "<!--" * 200_000, "<a href='" * 150_000, "<script>" * 100_000, '<a x="' * 150_000, "</a" * 300_000, "<a href=x>" * 50_000):
        html.links(page)


def test_anchors_of_pages(spark):
    rows = [(1, "http://h.com/a/b?q", "<base href=/c/><a href=d>t</a>"), (1, "http://h.com/a/b?q", "<base href=/c/><a href=d>t</a>"), (2, "http://h.com/a/b?q", None), (None, "http://h.com", "<a href='//o.com/x'>"), (3, None, "<a href=/x>")]
    got = anchors(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 0, "d", "t", "http://h.com/c/d")] * 2 + [(None, 0, "//o.com/x", "", "http://o.com/x"), (3, 0, "/x", "", None)]))
    assert anchors(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------ robots
def texts():
    rng = random.Random(9)
    parts = [
        "User-agent: *", "User-agent: bot", "user-AGENT : Bot/2.0 # x", "User-agent: other", "Disallow: /a", "Disallow:", "Allow: /a/b", "Disallow: /", "Disallow: *", "Crawl-delay: 5", "Crawl-delay: x", "Crawl-delay: 0",
        "", "", "   ", "# only a comment", "Sitemap: /s", "nonsense", "Request-rate: 1/5", "Disallow: /%61x", "Allow: /é", "Disallow: /a b", "Crawl-delay: 11",
    ]
    return [rng.choice(["\n", "\r\n"]).join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(120)]


PATHS = ["/", "/a", "/a/b", "/a/b/c", "/ax", "/%61x?y=1", "/q", "/%C3%A9t", "/a%20b", ""]


def test_policies_equal_the_standard_parser(spark):
    bodies = [(f"h{k}.com", 200, t) for k, t in enumerate(texts())] + [("gone.com", 404, "User-agent: *\nDisallow: /"), ("down.com", None, None), ("empty.com", 200, "")]
    df = spark.createDataFrame(bodies, "host string, status int, body string").repartition(5)
    urls = spark.createDataFrame([(f"http://{h}{p}", p) for h, _, _ in bodies for p in PATHS], "url string, p string")
    for agents in (("Bot/1.1", "*"), ("other", ), ("nobody", "*")):
        got = {(r.host, r.p): (r.allowed, r.delay) for r in robots.applied(urls, robots.policies(df), agents, 2.0).collect()}
        for h, status, body in bodies:
            plain = RobotFileParser()
            plain.parse((body if body is not None and (status or 200) < 400 else "").splitlines())
            delay = max(2.0, next((float(d) for a in agents if (d := plain.crawl_delay(a))), 0.0))
            for p in PATHS:
                assert got[h, p] == (any(plain.can_fetch(a, f"http://{h}{p}") for a in agents), delay), (body, p, agents)
        # the flat rule table says the same
        flat = {(r.host, r.p): r.allowed for r in allowed(urls, robots.table(robots.policies(df)), agents).collect()}
        assert flat == {k: v[0] for k, v in got.items()}


def test_bodies_are_asked_for_once_a_host(spark):
    def getter(url, form=None):
        if "down" in url:
            raise OSError("no route")
        return (404, {}, b"gone") if "gone" in url else (200, {}, f"User-agent: *\nDisallow: /x # {url}".encode())

    urls = spark.createDataFrame([(u,) for u in ("http://a.com/1", "http://A.com/2", "https://down.com/x", "http://gone.com/", "http://known.com/z", "nothing", None)], "url string")
    known = spark.createDataFrame([("known.com", 200, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    got = {r.host: (r.status, r.body) for r in robots_bodies(urls, getter, known, max_retries=1, sleep=lambda _: None, parts=2).collect()}
    assert set(got) == {"a.com", "down.com", "gone.com", "known.com"} and got["down.com"] == (None, None) and got["gone.com"][0] == 404
    assert got["a.com"][1].startswith("User-agent: *\nDisallow: /x # http://")
    cache = spark.createDataFrame([(h, *v) for h, v in got.items()], "host string, status int, body string")
    said = {r.url: r.allowed for r in robots.applied(urls.where("url LIKE 'http%'"), robots.policies(cache), ("*",)).collect()}
    assert said == {"http://a.com/1": True, "http://A.com/2": True, "https://down.com/x": True, "http://gone.com/": True, "http://known.com/z": False}
