"""Crawls and probes by host: pace, order, robots rules, limits and flags."""

import collections
import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.robotparser import RobotFileParser

import pytest

from crawlsight.functions import robots
from crawlsight.functions.html import page_columns, parsed
from crawlsight.sources import context, crawler, pages, probes
from crawlsight.sources.politeness import Pace

LOCATIONS = "<a href='https://{}/{}'>x</a>"


def web(hosts=4, size=30, seed=7):
    """Pages of some hosts with links, redirects (also to other hosts), errors and loops."""
    rng, out = random.Random(seed), {}
    for h in range(hosts):
        for i in range(size):
            links = "".join(f"<a href='/{rng.randrange(size)}'>x</a>" for _ in range(rng.randrange(4))) + f"<a href='https://h{(h + 1) % hosts}.example/1'>o</a>"
            kind = rng.random()
            if i and kind < 0.15:
                out[f"https://h{h}.example/{i}"] = {"status": 301, "location": f"/{rng.randrange(size)}"}
            elif i and kind < 0.25:
                out[f"https://h{h}.example/{i}"] = {"status": 302, "location": f"https://h{(h + 2) % hosts}.example/{rng.randrange(size)}"}
            elif i and kind < 0.3:
                out[f"https://h{h}.example/{i}"] = {"status": 404}
            else:
                out[f"https://h{h}.example/{i}"] = {"status": 200, "html": links}
    return out


def fetch_from(web, log=None):
    def fetch(url):
        if log:
            with open(log, "a") as f:
                f.write(json.dumps([url.split("/")[2], time.time()]) + "\n")
        return web[url]

    return fetch


def slow_crawl(web, seed, most, rules=""):
    """One queue, one page after another."""
    host, queue, rows = seed.split("/")[2], [seed], {}
    reader = RobotFileParser()
    reader.parse(rules.splitlines())
    while queue and len(rows) < most:
        url = queue.pop(0)
        if url in rows:
            continue
        if not reader.can_fetch("*", url):
            rows[url] = "Blocked by robots.txt"
            continue
        got = web.get(url)
        links = []
        if got is None:
            rows[url] = "Error"
        elif got["status"] in (301, 302):
            rows[url] = "Redirect"
            links = [got["location"] if "://" in got["location"] else f"https://{url.split('/')[2]}{got['location']}"]
        elif got["status"] >= 400:
            rows[url] = "HTTP Error"
        else:
            rows[url] = "Success"
            links = [u for u in page_columns(url, parsed(got["html"]))["links"] if u.split("/")[2] == host]
        queue += links
    return rows


@pytest.mark.parametrize("most", [7, 25, 1000])
def test_crawl_is_what_a_slow_queue_takes(spark, most):
    net, rules = web(), "User-agent: *\nDisallow: /1\nAllow: /12\n"
    seeds = [f"https://h{h}.example/0" for h in range(4)]
    found = crawler.crawl_sites(spark.createDataFrame([(s,) for s in seeds], "url string"), fetch_from(net), most, rules, delay=0.0)
    got = collections.defaultdict(dict)
    for r in found.select("site", "url", "crawl_status").collect():
        assert r.url not in got[r.site]
        got[r.site][r.url] = r.crawl_status.split(":")[0]
    assert got == {s: slow_crawl(net, s, most, rules) for s in seeds}


def test_no_two_requests_to_one_host_within_the_delay(spark, tmp_path):
    """Two sites that redirect into each other: every host is asked at its pace, whatever task asks."""
    log, net = str(tmp_path / "log"), web(hosts=2, size=8, seed=1)
    seeds = spark.createDataFrame([("https://h0.example/0",), ("https://h1.example/0",)], "url string").repartition(2)
    crawler.crawl_sites(seeds, fetch_from(net, log), 6, delay=0.5)
    times = collections.defaultdict(list)
    for host, at in map(json.loads, open(log)):
        times[host].append(at)
    assert set(times) == {"h0.example", "h1.example"} and sum(map(len, times.values())) == sum(len(slow_crawl(net, f"https://h{h}.example/0", 6)) for h in (0, 1))
    for own in times.values():
        own.sort()
        assert all(b - a >= 0.495 for a, b in zip(own, own[1:]))


def test_source_reads_hosts_as_partitions(spark, tmp_path):
    log, net = str(tmp_path / "log"), {u: g for u, g in web(hosts=3, size=12).items() if g["status"] != 302}
    spark.dataSource.register(crawler.crawl_source(fetch_from(net, log)))
    seeds = [f"https://h{h}.example/0" for h in range(3)]
    frame = spark.read.format("crawl").option("seeds", json.dumps([*seeds, seeds[0]])).option("max_pages", 9).option("delay", 0.2).load()
    assert frame.rdd.getNumPartitions() == 3
    rows = frame.collect()
    want = {(s, u) for s in seeds for u in slow_crawl(net, s, 9)}
    assert {(r.site, r.url) for r in rows} == want and len(rows) == len(want)
    parsed_rows = pages.crawl_table(frame)
    assert parsed_rows.where("crawl_status = 'Success'").agg({"word_count": "sum"}).first()[0] > 0
    times = collections.defaultdict(list)
    for host, at in map(json.loads, open(log)):
        times[host].append(at)
    first = {h: sorted(t)[: len([1 for s, u in want if h in s])] for h, t in times.items()}
    assert all(b - a >= 0.195 for own in first.values() for a, b in zip(own, own[1:]))


def test_pace_waits_per_host():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    pace = Pace(1.0, clock=lambda: now[0], sleep=sleep)
    for host in "abaab":
        pace.wait(host)
        now[0] += 0.25
        pace.done(host)
    # a at 0, b at once, a after the rest of its second, again, and b without waiting.
    assert slept == [0.75, 1.0]
    late = Pace(1.0, rested=False, clock=lambda: now[0], sleep=sleep)
    late.wait("c")
    assert slept[-1] == 1.0


def hosts(log):
    """A client defined in a function, so that executors need no test module."""

    class Hosts:
        """A network whose answers name what was asked."""

        def _say(self, how, url):
            with open(log, "a") as f:
                f.write(json.dumps([how, url, time.time()]) + "\n")

        def head(self, url):
            self._say("head", url)
            return {"n": 405, "e": 404, "m": 200}[url[-1]], url.endswith("m")

        def get(self, url):
            self._say("get", url)
            if url.endswith("e"):
                raise TimeoutError
            return 200, False

        def robots(self, root):
            self._say("robots", root)
            return "User-agent: *\nDisallow: /x%20y\nDisallow: /m" if "h1" in root else None

    return Hosts()


def test_probes_by_host(spark, tmp_path):
    log = str(tmp_path / "log")
    html = '<link rel="icon" href="/i.m"><a href="https://h1.example/m">1</a><a href="https://h1.example/x y/n">2</a><a href="https://h2.example/e">3</a><a href="/own">4</a><img src="/im">'
    raw = spark.createDataFrame([("https://s.example/b", html), ("https://s.example/a", html.replace("i.m", "other.m")), ("https://s.example/", "<p>")], "url string, html string")
    crawl = pages.crawl_table(raw)
    found = probes.targets(crawl, "https://s.example/", most_links=2, most_images=1)
    flags = found.flags.first()
    assert (flags.external_links_truncated, flags.images_truncated, flags.favicon_url) == (True, False, "https://s.example/other.m")
    assert sorted(tuple(r) for r in found.urls.collect()) == [("favicon", "https://s.example/other.m"), ("image", "https://s.example/im"), ("link", "https://h1.example/m"), ("link", "https://h1.example/x y/n")]
    whole = probes.targets(crawl, "https://s.example/", None, None)
    assert whole.flags.first().external_links_truncated is False
    probed = probes.probe(whole.urls, hosts(log), delay=0.3).cache()
    rows = {r.url: (r.kind, r.status, r.redirected, r.robots_blocked) for r in probed.collect()}
    assert rows["https://h1.example/m"] == ("link", 200, True, True)
    assert rows["https://h1.example/x y/n"] == ("link", 200, False, True)
    assert rows["https://h2.example/e"] == ("link", None, False, False)
    assert rows["https://s.example/other.m"] == ("favicon", 200, True, None) and rows["https://s.example/im"][3] is None
    asked = [json.loads(line) for line in open(log)]
    assert [u for how, u, _ in asked if how == "robots"].count("https://h1.example") == 1
    assert {u[-1] for how, u, _ in asked if how == "get"} == {"n", "e"}
    links = probes.link_probe(probed)
    assert links.count() == 3 and probes.image_probe(probed).columns == ["url", "status"]
    site = probes.with_probes(context.site_context(spark, "https://s.example/"), found, probed).first()
    assert (site.favicon_url, site.favicon_status, site.external_links_truncated) == ("https://s.example/other.m", 200, True)
    none = probes.targets(crawl.where("false"), "https://s.example/x")
    assert none.flags.first().favicon_url == "https://s.example/favicon.ico" and none.urls.count() == 1


def test_web_client():
    class Page(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response({"/moved": 302, "/no": 404}.get(self.path, 200))
            self.send_header("Location", "/there")
            self.end_headers()

        def do_GET(self):
            self.do_HEAD()
            self.wfile.write(b"User-agent: *\nDisallow: /q")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root, client = f"http://127.0.0.1:{server.server_port}", probes.WebClient(2)
        assert client.head(f"{root}/a") == (200, False) and client.get(f"{root}/no") == (404, False)
        assert client.head(f"{root}/moved") == (200, True) and client.robots(root).startswith("User-agent")
    finally:
        server.shutdown()


@pytest.mark.parametrize(
    "text, url, first, longest",
    [
        ("User-agent: *\nDisallow: /a\nAllow: /ab", "https://s.example/abc", True, False),
        ("User-agent: *\nDisallow: /*.html$", "https://s.example/x.html", False, True),
        ("User-agent: *\nDisallow: /*.html$", "https://s.example/x.html?y", False, False),
        ("User-agent: *\nDisallow: /%7Ejoe", "https://s.example/~joe/x", True, True),
        ("User-agent: *\nDisallow: /~joe", "https://s.example/%7Ejoe/x", True, True),
        ("User-agent: bot\nDisallow: /", "https://s.example/x", False, False),
        ("User-agent: *\nDisallow:", "https://s.example/x", False, False),
        ("User-agent: *\nDisallow: /", "https://s.example", True, True),
        ("", "https://s.example/x", False, False),
    ],
)
def test_robots_policies(text, url, first, longest):
    assert robots.blocks(text, url) is first and robots.blocks(text, url, "longest") is longest


def test_robots_first_match_is_the_common_reader():
    rng = random.Random(4)
    for _ in range(300):
        text = "User-agent: *\n" + "".join(f"{rng.choice(['Allow', 'Disallow'])}: /{''.join(rng.choices('ab%20', k=rng.randrange(4)))}\n" for _ in range(4))
        reader = RobotFileParser()
        reader.parse(text.splitlines())
        url = "https://s.example/" + "".join(rng.choices("ab% ", k=rng.randrange(4)))
        assert robots.blocks(text, url) is not reader.can_fetch("*", url)
    with pytest.raises(ValueError):
        robots.compiled("User-agent: *", "other")
