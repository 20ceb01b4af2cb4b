"""Site context: robots.txt, sitemaps and TLS facts as tables. ``probes`` adds what hosts answer."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import SITE


def declared_sitemap(robots_txt: str | None) -> str | None:
    """The first sitemap that robots.txt names."""
    for line in (robots_txt or "").splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == "sitemap" and value.strip():
            return value.strip()
    return None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_sitemap(text: str) -> tuple[list[str], list[tuple[str, str | None, str | None]]]:
    """(all locations, (url, code, href) of alternate links); a location without links has one row of nulls if its entry has none."""
    root = ET.fromstring(text)
    locations = [e.text.strip() for e in root.iter() if _local(e.tag) == "loc" and e.text and e.text.strip()]
    links = []
    for entry in (e for e in root.iter() if _local(e.tag) == "url"):
        own = next((c.text.strip() for c in entry if _local(c.tag) == "loc" and c.text), None)
        for child in entry:
            if own and _local(child.tag) == "link" and child.get("hreflang"):
                links.append((own, child.get("hreflang").strip().lower(), child.get("href", "")))
    return locations, links


def sitemap_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sitemap_urls, sitemap_hreflang) of sitemap files (path, text), parsed where they lie; malformed ones give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                try:
                    locations, links = parse_sitemap(text)
                except ET.ParseError:
                    continue
                rows += [(u, None, None) for u in locations] + links
            yield pd.DataFrame(rows, columns=["url", "code", "href"])

    rows = files.select("text").mapInPandas(run, "url string, code string, href string")
    return rows.where("code IS NULL").select("url"), rows.where("code IS NOT NULL")


def site_context(
    spark: SparkSession,
    base: str,
    robots_txt: str | None = None,
    sitemap: str | None = None,
    ssl: tuple[bool, datetime | None, bool | None, bool | None] | None = None,
    favicon_url: str | None = None,
    favicon_status: int | None = None,
) -> DataFrame:
    """The one-row context of a site from texts that were fetched elsewhere; ``probes.with_probes`` sets what a probe finds."""
    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    declared = declared_sitemap(robots_txt)
    valid = None
    if sitemap is not None:
        try:
            ET.fromstring(sitemap)
            valid = True
        except ET.ParseError:
            valid = False
    row = (
        robots_txt,
        f"{root}/robots.txt",
        declared or f"{root}/sitemap.xml",
        declared is not None,
        sitemap is not None,
        valid,
        ssl,
        favicon_url,
        favicon_status,
        False,
        False,
    )
    return spark.createDataFrame([row], SITE)
