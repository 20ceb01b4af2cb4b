"""The short audit: duplicates, orphans, issue rows and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.architecture import orphans
from ..operators.on_page import content_hash, duplicates
from ..operators.tables import Site

#: The classes of issues, in the order of the report.
CLASSES = ("Duplicate Titles", "Duplicate Descriptions", "Duplicate H1s", "Duplicate Body Content", "Orphan Pages")


def issue_pages(site: Site) -> DataFrame:
    """(issue, url, value) of every affected page."""
    found = [
        duplicates(site.crawl, F.col("title")),
        duplicates(site.crawl, F.col("description")),
        duplicates(site.crawl, F.col("h1")),
        duplicates(site.crawl, content_hash()),
        orphans(site).select("url", F.lit("").alias("value")).distinct(),
    ]
    return reduce(DataFrame.unionByName, [f.select(F.lit(n).alias("issue"), "url", "value") for n, f in zip(CLASSES, found)])


def issues(site: Site) -> DataFrame:
    """(issue, impact, affected_pages) of each class that occurs."""
    return issue_pages(site).groupBy("issue").agg(
        F.count("*").alias("impact"), F.countDistinct("url").alias("affected_pages")
    )


def score(site: Site) -> DataFrame:
    """One row: 100 less the mean impact of the classes that occur, from 0 to 100."""
    lost = F.coalesce(F.sum("impact"), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))
    rounded = F.round(100 - lost, 1)
    return issues(site).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded)).cast("int").alias("score"))


def inbound_links(site: Site) -> DataFrame:
    """(url, n): how often each absolute href occurs."""
    hrefs = site.crawl.select(F.explode("h.anchors.href").alias("url")).where(F.col("url").rlike("^https?://"))
    return hrefs.groupBy("url").agg(F.count("*").alias("n"))
