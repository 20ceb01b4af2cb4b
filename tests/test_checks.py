"""Checks on hand-written pages: one that each affects and one that it does not."""

from datetime import datetime

import pytest

from crawlsight.operators import architecture, graph
from crawlsight.operators.tables import site
from crawlsight.plans import health, site_audit
from crawlsight.schemas import SITE
from crawlsight.sources.pages import crawl_table

A, B, C = "https://s.example/a", "https://s.example/b", "https://s.example/c"


def crawl(spark, pages):
    """Pages as (url, html) or (url, html, status, redirect target)."""
    rows = []
    for url, html, *rest in pages:
        status = rest[0] if rest else "200"
        kind = "Success" if status == "200" else "Redirect" if status[0] == "3" else "HTTP Error"
        rows.append((url, html, status, kind, rest[1] if len(rest) > 1 else None))
    frame = spark.createDataFrame(rows, "url string, html string, status string, crawl_status string, redirect_target string")
    return crawl_table(frame).cache()


def affected(spark, pages, *ids, **context):
    made = site(crawl(spark, pages), **context)
    wanted = [c for c in health.checks(extra=True) if c.check_id in ids]
    assert len(wanted) == len(ids)
    found = {i: set() for i in ids}
    for row in health.flags(made, wanted).collect():
        found[row.check_id].add(row.url)
    return found if len(ids) > 1 else found[ids[0]]


CASES = {
    "C012": ('<META NAME="Robots" CONTENT="NOINDEX">', '<meta name="description" content="noindex">'),
    "C015": ("<p>Page not found</p>", "<p>Welcome</p>"),
    "C036": ('<meta http-equiv="REFRESH" content="0">', '<meta http-equiv="x" content="refresh">'),
    "C050": ("<h1>a</h1><H1>b</H1>", "<h1>a</h1><h2>b</h2>"),
    "C060": ("<h1>a</h1><h3>b</h3>", "<h2>a</h2><h1>b</h1><h3>c</h3>"),
    "C059": ("<html><p>x</p>", '<html lang="en"><p>x</p>'),
    "C073": ('<a href="/x" rel="nofollow me">x</a>', '<a href="https://o.example/x" rel="nofollow">x</a>'),
    "C074": ('<a href="/x"><b>Click</b> here</a><a href="/y"> </a>', '<a href="/x">flowers</a><a>here</a>'),
    "C082": ('<a href="HTTP://o.example/">x</a>', '<a href="http://s.example/">x</a>'),
    "C086": ('<img src="//cdn.example/a.webp">', '<img src="/a.webp">'),
    "C090": ('<a href="/x?UTM_Source=a">x</a>', '<a href="/x?source=a">x</a>'),
    "C093": ('<a href="https://amzn.to/x">x</a>', '<a href="https://amzn.to/x" rel="sponsored">x</a>'),
    "C094": ('<a href=" JavaScript:void(0)">x</a>', '<a href="/javascript:">x</a>'),
    "C095": ('<form action="http://o.example/">', '<form action="/x">'),
    "C096": ('<link rel="alternate" hreflang="english" href="/e">', '<link rel="alternate" hreflang="en-GB" href="/e">'),
    "C101": (
        '<link rel=alternate hreflang=x-default href=/a><link rel=alternate hreflang=X-Default href=/b>',
        '<link rel=alternate hreflang=x-default href=/a>',
    ),
    "C106": (
        '<link rel=alternate hreflang=en href=/a><link rel=alternate hreflang=EN href=/b>',
        '<link rel=alternate hreflang=en href=/a><link rel=alternate hreflang=fr href=/b>',
    ),
    "C109": ('<script type="application/ld+json">{bad</script>', '<script type="application/ld+json"> </script>'),
    "C110": (
        '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Organization"]}]}</script>',
        '<script type="application/ld+json">{"@type":"Organization","name":"x"}</script>',
    ),
    "C113": ("<meta name=Twitter:card content=x>", '<meta name="twitter:card" content="x">'),
    "C116": ('<link rel="stylesheet" href="/i.css">', '<link rel="Shortcut ICON" href="/i">'),
    "C117": ("<p>x</p>", '<meta name="viewport" content="x">'),
    "C121": ("<img>" * 101, "<img>" * 100),
    "C122": ("<head><script src=a></script></head>", "<head><script src=a defer></script></head><script src=b></script>"),
    "C123": ("<img width=1>", "<img width=1 height=1>"),
    "C124": ('<img src="/A.JPG?x=1">', '<img src="/a.webp?x=.jpg">'),
    "C125": ("<img><img>", "<img><img loading=LAZY>"),
    "C127": ("<i></i>" * 1501, "<i></i>" * 1500),
    "C130": ("<img>", '<img alt="x">'),
    "C131": ('<img alt=" ">', "<img>"),
    "C134": ('<label for="q">x</label><input id="r">', '<label>x<input></label><input type="HIDDEN"><label for="q"></label><input id="q">'),
    "C114": ("<html amp><p>x</p>", '<html amp><link rel="amphtml" href="/x">'),
}


@pytest.fixture(scope="module")
def cases(spark):
    pages = []
    for check_id, (bad, good) in CASES.items():
        pages += [(f"https://s.example/bad-{check_id}", bad), (f"https://s.example/good-{check_id}", good)]
    wanted = [c for c in health.checks(extra=True) if c.check_id in CASES]
    rows = health.page_flags(site(crawl(spark, pages)).crawl, wanted).collect()
    return {(r.check_id, r.url) for r in rows}


@pytest.mark.parametrize("check_id", sorted(CASES))
def test_page_rule(cases, check_id):
    assert (check_id, f"https://s.example/bad-{check_id}") in cases
    assert (check_id, f"https://s.example/good-{check_id}") not in cases


def test_language_of_content(spark):
    french = " ".join(["le la de et les des est que pour dans"] * 3)
    found = affected(spark, [(A, f'<html lang="en"><p>{french}'), (B, f'<html lang="fr-CA"><p>{french}'), (C, '<html lang="en"><p>le la')], "C107")
    assert found == {A}


def test_canonicals(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (A, link.format("/b")),
        (B, link.format(C) + '<meta name="robots" content="noindex">'),
        (C, link.format("https://o.example/x")),
        ("https://s.example/d", link.format("/gone")),
        ("https://s.example/gone", "", "404"),
    ]
    found = affected(spark, pages, "C017", "C018", "C019", "C088")
    assert found["C017"] == {A}
    assert found["C018"] == {C}
    assert found["C019"] == {A, B}
    assert found["C088"] == {"https://s.example/d"}


def test_redirects(spark):
    u = "http://s.example/{}"
    pages = [
        (u.format("a"), "", "301", u.format("b")),
        (u.format("b"), "", "302", u.format("a")),
        (u.format("x"), "", "301", u.format("a")),
        (u.format("p"), "", "301", u.format("q")),
        (u.format("q"), "", "301", "https://s.example/q"),
        (u.format("g"), "", "308", u.format("gone")),
        (u.format("gone"), "", "410"),
    ]
    found = affected(spark, pages, "C031", "C032", "C033", "C035", "C039", "C024")
    assert found["C032"] == {u.format(x) for x in "abx"}
    assert found["C035"] == {u.format("g")}
    assert found["C039"] == {u.format("p")}
    assert found["C033"] == {u.format("b")}
    assert len(found["C031"]) == 6
    assert u.format("q") not in found["C024"] and u.format("p") in found["C024"]
    chains = graph.redirect_chains(site(crawl(spark, pages)))
    assert {(r.url[-1], r.hops, r.is_loop) for r in chains.collect()} == {
        ("a", 2, True), ("b", 2, True), ("x", 3, True), ("p", 2, False), ("q", 1, False), ("g", 1, False)
    }


def test_url_twins(spark):
    pages = [("https://s.example/t", ""), ("https://s.example/t/", ""), ("https://www.s.example/w", ""), ("https://o.example/", "")]
    found = affected(spark, pages, "C037", "C038")
    assert found["C037"] == {"https://s.example/t", "https://s.example/t/"}
    assert found["C038"] == {"https://s.example/t", "https://s.example/t/", "https://www.s.example/w"}


def test_click_depth_and_orphans(spark):
    url = lambda i: f"https://s.example/p{i}" if i else "https://s.example/"
    pages = [(url(i), f'<a href="{url(i + 1)}">next page {i}</a><a href="{url(0)}">start</a>') for i in range(8)]
    pages += [("https://s.example/alone", '<a href="/alone">self</a>')]
    made = site(crawl(spark, pages))
    depth = {r.url: r.depth for r in graph.click_depths(made).collect()}
    assert depth == {url(i): i for i in range(8)}
    found = affected(spark, pages, "C066", "C067", "C068", "C078")
    assert found["C066"] == {"https://s.example/alone"}
    assert found["C067"] == {url(i) for i in range(4, 8)} and found["C068"] == {url(6), url(7)}
    assert found["C078"] == {url(i) for i in range(3, 8)}
    assert {r.url for r in architecture.orphans_resolved(made).collect()} == {"https://s.example/alone"}


def test_links_to_broken_and_moved(spark):
    pages = [(A, f'<a href="/b">x</a><a href="{C}#f">y</a>'), (B, "", "500"), (C, "", "301", A)]
    found = affected(spark, pages, "C071", "C072", "C034")
    assert found["C071"] == {A} and found["C072"] == set() == found["C034"]


def test_anchor_mismatch_and_link_counts(spark):
    target = (B, "<title>Garden tools</title>")
    pages = [(A, '<a href="/b">blue widgets</a>'), target, (C, '<a href="/b">garden help</a>')]
    assert affected(spark, pages, "C075") == {A}
    many = "".join(f'<a href="/x{i}">x{i}</a>' for i in range(10))
    pages = [(f"https://s.example/{i}", many) for i in range(5)] + [(A, many[:40] + "</a>")]
    assert affected(spark, pages, "C077") == {A}
    assert affected(spark, pages[2:], "C077") == set()


def test_hreflang_clusters(spark):
    entry = '<link rel="alternate" hreflang="{}" href="{}">'
    both = entry.format("en", A) + entry.format("fr", B)
    pages = [(A, both), (B, both), (C, entry.format("de", C) + entry.format("en", A))]
    found = affected(spark, pages, "C097", "C103", "C102")
    assert found["C097"] == {C} and found["C103"] == {C} and found["C102"] == {A, B, C}
    maps = spark.createDataFrame([(A, "en", A), (A, "fr", B), (C, "de", A)], "url string, code string, href string")
    assert affected(spark, pages, "C105", sitemap_hreflang=maps) == {C}


def test_probes(spark):
    out = "https://o.example/{}"
    link = '<a href="https://o.example/{}">x</a>'
    pages = [(A, link.format("dead") * 3 + '<img src="/i.png">'), (B, link.format("moved")), (C, link.format("shut"))]
    probes = spark.createDataFrame(
        [(out.format("dead"), 404, False, False), (out.format("moved"), 200, True, False), (out.format("shut"), None, False, True)],
        "url string, status int, redirected boolean, robots_blocked boolean",
    )
    images = spark.createDataFrame([("https://s.example/i.png", 500)], "url string, status int")
    found = affected(spark, pages, "C081", "C083", "C084", "C085", "C091", link_probe=probes, image_probe=images)
    assert found == {"C081": {A}, "C083": {B}, "C084": {C}, "C085": {A}, "C091": {A}}


def context(spark, **over):
    row = {
        "robots_txt": "", "robots_txt_url": "", "sitemap_url": "", "sitemap_declared_in_robots": True, "sitemap_found": True,
        "sitemap_valid": True, "ssl_info": (True, datetime(2030, 1, 1), True, False), "favicon_url": "", "favicon_status": 200,
        "external_links_truncated": False, "images_truncated": False,
    } | over
    return spark.createDataFrame([tuple(row.values())], SITE)


SITE_IDS = ("C001", "C002", "C003", "C004", "C005", "C006", "C010", "C026", "C027", "C028", "C087")


def sitewide(spark, **over):
    found = affected(spark, [(A, ""), (B, "")], *SITE_IDS, context=context(spark, **over), as_of=datetime(2029, 1, 1))
    assert all(urls in (set(), {A, B}) for urls in found.values())
    return {i for i, urls in found.items() if urls}


def test_site_context(spark):
    assert sitewide(spark) == set()
    assert sitewide(spark, robots_txt=None) == {"C001"}
    assert sitewide(spark, robots_txt="# x\nno colon\nNoindex: /x") == {"C002"}
    assert sitewide(spark, robots_txt="User-agent: *\nUser-agent: bot\nDisallow: /") == set()
    assert sitewide(spark, robots_txt="User-agent: *\nDisallow: /\nUser-agent: bot") == {"C003"}
    assert sitewide(spark, robots_txt="Disallow: /app.css") == {"C004"}
    assert sitewide(spark, sitemap_found=False) == {"C005"}
    assert sitewide(spark, sitemap_valid=False) == {"C006"}
    assert sitewide(spark, sitemap_valid=None, sitemap_declared_in_robots=False) == {"C010"}
    assert sitewide(spark, ssl_info=(True, datetime(2028, 1, 1), True, False)) == {"C026"}
    assert sitewide(spark, ssl_info=(True, datetime(2029, 1, 11), True, False)) == {"C027"}
    assert sitewide(spark, ssl_info=(True, None, False, True)) == {"C026", "C028"}
    assert sitewide(spark, favicon_status=404) == {"C087"}


def test_no_context_is_unknown(spark):
    found = affected(spark, [(A, "")], "C001", "C005", "C026", "C087")
    assert found == {"C001": {A}, "C005": {A}, "C026": set(), "C087": set()}


def test_blocked_by_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/open\nDisallow: /*.pdf$"
    pages = [(A, ""), ("https://s.example/a/open", ""), ("https://s.example/x.pdf", ""), (B, "")]
    assert affected(spark, pages, "C011", context=context(spark, robots_txt=text)) == {A, "https://s.example/x.pdf"}


def test_score_of_one_error(spark):
    good = '<title>A title that is neither too short nor long</title><h1>Head {0}</h1>'
    pages = [(f"https://s.example/p{i}", good.format(i).replace("title that", f"title {i} that")) for i in range(3)]
    pages += [("https://s.example/p3", "<h1>Head</h1>")]
    made = site(crawl(spark, pages))
    found = {r.check_id: r for r in health.findings(made).collect()}
    assert found["C041"].deduction == 0.75 and found["C041"].impact_score == 3
    scores = {r.category: r.score for r in health.category_scores(health.findings(made).where("check_id = 'C041'")).collect()}
    assert scores["On-Page & Duplicates"] == 25 and scores["Links"] == 100


def test_empty_crawl(spark):
    made = site(crawl(spark, [(A, "")]).where("false"))
    row = health.health(made).first()
    assert (row.health_score, row.grade, row.pages_crawled, row.issues_found) == (100, "A", 0, 0)
    assert site_audit.score(made).first().score == 100


def test_invariants(spark):
    pages = [(A, "<title>x</title>"), (B, '<meta name="viewport" content="x">'), (C, "", "404")]
    found = affected(spark, pages, "C117", "C129", "C034", "C072", "C067", "C068")
    assert found["C117"] == found["C129"] and found["C034"] == found["C072"] and found["C068"] <= found["C067"]
