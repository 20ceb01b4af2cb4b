"""Probes of outgoing links, images and the favicon: what is asked, and what hosts answer.

Targets are distinct URLs. The limits of a run are parameters: with them the first targets in
order of URL are taken and a flag tells that there are more, without them all are. Targets are
asked by host (see ``politeness``): one task holds a host's robots rules and its pace. Each
target is asked by HEAD, and by GET where a host answers HEAD with an error.

The network is a parameter: a client has ``head(url)`` and ``get(url)``, which return (status,
redirected) or raise, and ``robots(root)``, which returns a text or none. ``WebClient`` is one.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.urls import netloc
from .politeness import DELAY, Pace, by_host

#: How many links and images a probe run of the model takes.
MOST_LINKS, MOST_IMAGES = 50, 30
#: Answers to HEAD that say nothing, besides errors.
NO_HEAD = (405, 501)

PROBED = "kind string, url string, status int, redirected boolean, robots_blocked boolean"


@dataclass
class Targets:
    """``urls`` (kind, url) of links, images and the favicon; ``flags`` is one row: what was cut, and the favicon's URL."""

    urls: DataFrame
    flags: DataFrame


def targets(crawl: DataFrame, seed: str, most_links: int | None = MOST_LINKS, most_images: int | None = MOST_IMAGES, order: list[Column] | None = None) -> Targets:
    """What a probe of a crawl asks.

    ``order`` is the order of the crawl, for the first declared icon; without it the seed
    comes first and other pages by URL. Without any icon it is the seed's ``/favicon.ico``.
    """
    parts = urlsplit(seed)
    host, root = parts.netloc.lower(), f"{parts.scheme or 'https'}://{parts.netloc}"
    links = crawl.select(F.explode("links").alias("url")).where(netloc(F.col("url")) != host)
    images = crawl.select(F.explode("image_urls").alias("url"))

    def capped(found: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        found = found.where("url <> ''").distinct()
        if most is None:
            return found, found.limit(1).agg(F.lit(False).alias("cut"))
        # One more than is taken tells whether there are more.
        return found.orderBy("url").limit(most), found.limit(most + 1).agg((F.count("*") > most).alias("cut"))

    (links, links_cut), (images, images_cut) = capped(links, most_links), capped(images, most_images)
    first = order or [F.col("url") != seed, F.col("url")]
    icon = crawl.where(F.size("icon_urls") > 0).agg(F.min_by(F.element_at("icon_urls", 1), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)])).alias("icon"))
    icon = icon.select(F.coalesce("icon", F.lit(f"{root}/favicon.ico")).alias("url"))
    # Each of these is one row.
    flags = (
        links_cut.withColumnRenamed("cut", "external_links_truncated")
        .join(F.broadcast(images_cut.withColumnRenamed("cut", "images_truncated")))
        .join(F.broadcast(icon.withColumnRenamed("url", "favicon_url")))
    )
    kinds = (("link", links), ("image", images), ("favicon", icon))
    frames = [f.select(F.lit(kind).alias("kind"), "url") for kind, f in kinds]
    return Targets(frames[0].unionByName(frames[1]).unionByName(frames[2]), flags)


def probe(urls: DataFrame, client, delay: float = DELAY, policy: str = "first") -> DataFrame:
    """What hosts answer to ``urls`` (kind, url): status (null: no answer), redirected; of links also whether robots.txt blocks them."""

    def ask(url: str) -> tuple[int | None, bool]:
        try:
            status, redirected = client.head(url)
            return client.get(url) if status in NO_HEAD or status >= 400 else (status, redirected)
        except Exception:  # no answer is a result
            return None, False

    def rules(root: str) -> str | None:
        try:
            return client.robots(root)
        except Exception:  # a host without readable rules blocks nothing
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, known = Pace(delay), {}
        for frame in frames:
            rows = []
            for kind, url, host in zip(frame["kind"], frame["url"], frame["host"]):
                pace.wait(host)
                status, redirected = ask(url)
                pace.done(host)
                blocked = None
                if kind == "link":
                    root = "://".join(url.split("://")[:1] + [host])
                    if root not in known:
                        pace.wait(host)
                        known[root] = rules(root)
                        pace.done(host)
                    blocked = robots.blocks(known[root], url, policy)
                rows.append((kind, url, status, redirected, blocked))
            out = pd.DataFrame(rows, columns=["kind", "url", "status", "redirected", "robots_blocked"])
            yield out.astype({"status": "Int32", "redirected": "boolean", "robots_blocked": "boolean"})

    return by_host(urls, ["kind", "url"]).select("kind", "url", "host").mapInPandas(run, PROBED)


def link_probe(probed: DataFrame) -> DataFrame:
    return probed.where("kind = 'link'").select("url", "status", "redirected", "robots_blocked")


def image_probe(probed: DataFrame) -> DataFrame:
    return probed.where("kind = 'image'").select("url", "status")


def with_probes(context: DataFrame, found: Targets, probed: DataFrame) -> DataFrame:
    """The site's context with the favicon's answer and the flags; every part is one row."""
    favicon = probed.where("kind = 'favicon'").select(F.col("status").alias("favicon_status"))
    plain = context.drop("favicon_url", "favicon_status", "external_links_truncated", "images_truncated")
    return plain.join(F.broadcast(found.flags)).join(F.broadcast(favicon)).select(*context.columns)


class WebClient:
    """Requests over HTTP that follow redirects and give up after ``timeout`` seconds."""

    def __init__(self, timeout: float = 6.0, agent: str = "crawlsight"):
        self.timeout, self.agent = timeout, agent

    def _ask(self, url: str, method: str):
        request = urllib.request.Request(url, headers={"User-Agent": self.agent}, method=method)
        return urllib.request.urlopen(request, timeout=self.timeout)

    def _status(self, url: str, method: str) -> tuple[int, bool]:
        try:
            with self._ask(url, method) as answer:
                return answer.status, answer.url != url
        except urllib.error.HTTPError as error:
            with error:
                return error.code, error.url != url

    def head(self, url: str) -> tuple[int, bool]:
        return self._status(url, "HEAD")

    def get(self, url: str) -> tuple[int, bool]:
        return self._status(url, "GET")

    def robots(self, root: str) -> str | None:
        """The text; one that blocks all where the host forbids reading it, none where there is none."""
        try:
            with self._ask(f"{root}/robots.txt", "GET") as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            with error:
                return "User-agent: *\nDisallow: /" if error.code in (401, 403) else None
