"""Breadth-first crawls of sites, one distributed fetch per depth.

The network is a parameter: ``fetch(url)`` returns a dict with status, html, location, seconds,
mime_type and headers, or raises; ``web_fetch`` makes one with a time limit. Each depth's pages
are fetched by host (see ``politeness``): a host is in one task, and ``delay`` seconds pass
between two requests to it, whatever number of tasks and sites there are. The driver only
steers the depth. Pages are taken in the order of a site's queue: a page's links stand behind
those of the pages before it, in the order of its markup, so ``max_pages`` keeps what a single
slow queue would keep. Pages that robots.txt blocks get a row that says so instead of ending the
crawl.

``CrawlSource`` reads the same from ``spark.read``: its partitions are hosts, and each is a queue.
"""

from __future__ import annotations

import http.client
import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import robots
from ..functions.html import normalise_url, page_columns, parsed, resolve
from ..functions.urls import REDIRECTS, netloc, normalised
from ..schemas import FETCHED, HEADERS
from .pages import crawl_table
from .politeness import DELAY, Pace, by_host
from .storage import checkpointed

_COLUMNS = [column.split()[0] for column in FETCHED.split(", ")]
#: Pages that a task holds before it hands them on.
HELD_PAGES = 64


def _root(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


def fetched_row(url: str, fetch: Callable[[str], dict], rules: str | None, policy: str = "first") -> dict:
    """The row of FETCHED that a fetch of ``url`` gives under the rules of its host."""
    out = dict.fromkeys(_COLUMNS)
    out |= {"url": url, "html": "", "mime_type": "", "crawl_time_s": 0.0, "status": "Error"}
    if robots.blocks(rules, url, policy):
        return out | {"crawl_status": "Blocked by robots.txt"}
    try:
        got = fetch(url)
    except Exception as error:  # a page that can't be fetched is a result, not a failure of the crawl
        return out | {"crawl_status": f"Error: {error}"}
    status = int(got["status"])
    headers = {k.lower(): v for k, v in got.get("headers", {}).items()}
    out |= {"status": str(status), "crawl_time_s": round(float(got.get("seconds", 0.0)), 2)}
    out |= {column: headers.get(name.lower(), "") for name, column in HEADERS.items()}
    out |= {"mime_type": got.get("mime_type") or headers.get("content-type", "")}
    if str(status) in REDIRECTS:
        location = got.get("location") or ""
        return out | {"crawl_status": "Redirect", "redirect_target": normalise_url(resolve(url, location)) if location else ""}
    if status >= 400:
        return out | {"crawl_status": "HTTP Error"}
    return out | {"crawl_status": "Success", "html": got.get("html") or ""}


def web_fetch(timeout: float = 12.0, agent: str = "crawlsight") -> Callable[[str], dict]:
    """A fetch over HTTP that follows no redirect and gives up after ``timeout`` seconds."""

    def fetch(url: str) -> dict:
        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        link, began = kind(parts.netloc, timeout=timeout), time.time()
        try:
            link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": agent})
            answer = link.getresponse()
            body, headers = answer.read(), dict(answer.getheaders())
        finally:
            link.close()
        charset = answer.headers.get_content_charset() or "utf-8"
        html = body.decode(charset, "replace")
        return {"status": answer.status, "html": html, "location": answer.getheader("Location"), "seconds": time.time() - began, "headers": headers}

    return fetch


def _rules_of(root: str, read: Callable[[str], str | None] | str | None, known: dict[str, str | None], host: str, pace: Pace) -> str | None:
    """A root's robots.txt: a fixed text, or read once per task, at the host's pace."""
    if read is None or isinstance(read, str):
        return read
    if root not in known:
        pace.wait(host)
        try:
            known[root] = read(root)
        except Exception:  # as if there were none
            known[root] = None
        pace.done(host)
    return known[root]


def crawl_sites(
    seeds: DataFrame,
    fetch: Callable[[str], dict],
    max_pages: int = 100,
    robots_txt: Callable[[str], str | None] | str | None = None,
    delay: float = DELAY,
    policy: str = "first",
) -> DataFrame:
    """The crawl table, with ``site`` and ``depth``, of every seed (column url): links on the seed's host and redirect targets, breadth first.

    At most ``max_pages`` a site. ``robots_txt`` is one text for all hosts, or a function
    from ``scheme://host`` to a text or none.
    """
    spark = seeds.sparkSession

    def run(frames: Iterator[pd.DataFrame], rested: bool) -> Iterator[pd.DataFrame]:
        pace, known = Pace(delay, rested), {}
        for frame in frames:
            rows = []
            for url, host, site in zip(frame["url"], frame["host"], frame["site"]):
                rules = _rules_of(_root(url), robots_txt, known, host, pace)
                if not robots.blocks(rules, url, policy):
                    pace.wait(host)
                rows.append(fetched_row(url, fetch, rules, policy) | {"site": site})
                if not rows[-1]["crawl_status"].startswith("Blocked"):
                    pace.done(host)
                if len(rows) == HELD_PAGES:
                    yield pd.DataFrame(rows, columns=[*_COLUMNS, "site"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*_COLUMNS, "site"])

    frontier = seeds.select(normalised(F.col("url")).alias("url")).distinct()
    frontier = checkpointed(spark, frontier.select("url", F.col("url").alias("site"), F.lit(1).alias("place")))
    found, depth = None, 0
    while not frontier.isEmpty():
        asked = by_host(frontier, ["place", "site"]).select("url", "host", "site")
        level = asked.mapInPandas(lambda frames, rested=depth == 0: run(frames, rested), f"{FETCHED}, site string")
        level = checkpointed(spark, crawl_table(level).withColumn("depth", F.lit(depth)))
        found = level if found is None else found.unionByName(level)
        placed = level.join(frontier, ["site", "url"])
        links = placed.select("site", "place", F.posexplode("links").alias("pos", "url")).where(netloc(F.col("url")) == netloc(F.col("site")))
        moved = placed.where("redirect_target <> ''").select("site", "place", F.lit(0).alias("pos"), normalised(F.col("redirect_target")).alias("url"))
        seen = links.unionByName(moved).where(F.col("url").rlike("^https?://"))
        seen = seen.groupBy("site", "url").agg(F.min(F.struct("place", "pos")).alias("seen"))
        new = seen.join(found.select("site", "url"), ["site", "url"], "left_anti")
        # A site's next pages by their places in its queue, as far as its budget goes.
        place = F.row_number().over(Window.partitionBy("site").orderBy("seen", "url"))
        new = new.select("site", "url", place.alias("place")).where(F.col("place") <= max_pages)
        used = found.groupBy("site").agg(F.count("*").alias("used"))
        new = new.join(used, "site").where(F.col("place") + F.col("used") <= max_pages)
        frontier = checkpointed(spark, new.select("url", "site", "place"))
        depth += 1
    return found


def crawl_site(
    spark: SparkSession,
    seed: str,
    fetch: Callable[[str], dict],
    max_pages: int = 100,
    robots_txt: Callable[[str], str | None] | str | None = "",
    delay: float = DELAY,
    policy: str = "first",
) -> DataFrame:
    """As ``crawl_sites`` for one seed, without the column ``site``."""
    seeds = spark.createDataFrame([(seed,)], "url string")
    return crawl_sites(seeds, fetch, max_pages, robots_txt, delay, policy).drop("site", "depth")


def host_queue(
    seeds: list[str], fetch: Callable[[str], dict], max_pages: int, robots_txt: Callable[[str], str | None] | str | None, pace: Pace, policy: str = "first"
) -> Iterator[dict]:
    """Rows of FETCHED and ``site`` of the seeds of one host, from one queue per site; links and redirects that leave the host are not followed."""
    known: dict[str, str | None] = {}
    for seed in seeds:
        host = urlsplit(seed).netloc.lower()
        queue, seen, taken = deque([normalise_url(seed)]), {normalise_url(seed)}, 0
        while queue and taken < max_pages:
            url = queue.popleft()
            rules = _rules_of(_root(url), robots_txt, known, host, pace)
            if not robots.blocks(rules, url, policy):
                pace.wait(host)
            row = fetched_row(url, fetch, rules, policy)
            if not row["crawl_status"].startswith("Blocked"):
                pace.done(host)
            taken += 1
            yield row | {"site": normalise_url(seed)}
            links = [row["redirect_target"]] if row["redirect_target"] else page_columns(url, parsed(row["html"]))["links"] if row["html"] else []
            for link in links:
                if link not in seen and link.startswith(("http://", "https://")) and urlsplit(link).netloc.lower() == host:
                    seen.add(link)
                    queue.append(link)


class _Host(InputPartition):
    def __init__(self, seeds: list[str]):
        super().__init__(None)
        self.seeds = seeds


def crawl_source(fetch: Callable[[str], dict], robots_txt: Callable[[str], str | None] | str | None = None) -> type[DataSource]:
    """The data source ``crawl`` over a network, to be registered: ``spark.dataSource.register(crawl_source(web_fetch()))``.

    Options: ``seeds`` (a JSON list of URLs), ``max_pages`` (100), ``delay`` (0.5) and ``policy``.
    Its rows are FETCHED and ``site``, ready for ``crawl_table``. A partition is a host: all of
    its seeds, one after another, so that no two tasks ask one host. Rows leave the task as they
    come; a lost executor costs the hosts that it was reading, which are crawled again.
    """

    class CrawlReader(DataSourceReader):
        def __init__(self, options):
            self.seeds = list(dict.fromkeys(json.loads(options["seeds"])))
            self.most, self.delay = int(options.get("max_pages", 100)), float(options.get("delay", DELAY))
            self.policy = options.get("policy", "first")

        def partitions(self):
            hosts: dict[str, list[str]] = {}
            for seed in self.seeds:
                hosts.setdefault(urlsplit(seed).netloc.lower(), []).append(seed)
            return [_Host(seeds) for seeds in hosts.values()]

        def read(self, partition):
            for row in host_queue(partition.seeds, fetch, self.most, robots_txt, Pace(self.delay), self.policy):
                yield tuple(row[c] for c in [*_COLUMNS, "site"])

    class CrawlSource(DataSource):
        @classmethod
        def name(cls):
            return "crawl"

        def schema(self):
            return f"{FETCHED}, site string"

        def reader(self, schema):
            return CrawlReader(self.options)

    return CrawlSource
