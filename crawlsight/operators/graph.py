"""Walks over the redirect graph and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .tables import Site

#: Redirects that a walk follows at most.
MAX_HOPS = 20


def redirect_chains(site: Site) -> DataFrame:
    """(url, hops, final, is_loop, before) for every URL that redirects; ``before`` is the URL before the final one.

    All walks step together: a step joins the walks' ends with the redirects once.
    A walk ends where no redirect leaves, where it meets a URL that it has seen, or
    after MAX_HOPS. The first steps leave few walks, so later joins are small.
    """

    def make() -> DataFrame:
        edges = site.redirects.select(F.col("url").alias("from_"), F.col("target").alias("next"))
        walks = edges.select(
            F.col("from_").alias("url"),
            F.lit(1).alias("hops"),
            F.col("next").alias("final"),
            F.col("from_").alias("before"),
            F.array("from_").alias("seen"),
            F.array_contains(F.array("from_"), F.col("next")).alias("is_loop"),
        )
        done, columns = None, ("url", "hops", "final", "is_loop", "before")
        for step in range(1, MAX_HOPS):
            joined = walks.join(edges, walks["final"] == edges["from_"], "left")
            ended = F.col("is_loop") | F.col("next").isNull()
            kept = joined.where(ended).select(*columns)
            done = kept if done is None else done.unionByName(kept)
            seen = F.concat("seen", F.array("final"))
            walks = _cut(
                site,
                joined.where(~ended).select(
                    "url",
                    (F.col("hops") + 1).alias("hops"),
                    F.col("next").alias("final"),
                    F.col("final").alias("before"),
                    seen.alias("seen"),
                    F.array_contains(seen, F.col("next")).alias("is_loop"),
                ),
            )
            if step < MAX_HOPS - 1 and walks.isEmpty():
                break
        return done.unionByName(walks.select(*columns))

    return site._once("chains", make)


def homepage(site: Site) -> DataFrame:
    """The crawled URL with the shortest path; the smaller URL wins a tie."""
    length = F.length(F.regexp_replace(urls.path(F.col("url")), "^/+|/+$", ""))
    return site.crawl.agg(F.min(F.struct(length.alias("length"), "url"))["url"].alias("url")).where("url IS NOT NULL")


def click_depths(site: Site) -> DataFrame:
    """(url, depth) of every crawled URL that links reach from the homepage.

    One frontier per depth: neighbours of the frontier that no earlier frontier
    has. The loop runs as often as the site is deep.
    """

    def make() -> DataFrame:
        edges = site.internal.select("url", "target").distinct()
        edges = _cut(site, edges.join(site.status.select("target"), "target", "left_semi"))
        frontier = _cut(site, homepage(site).select("url", F.lit(0).alias("depth")))
        reached, depth = frontier, 0
        while not frontier.isEmpty():
            depth += 1
            near = edges.join(frontier.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct()
            frontier = _cut(site, near.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
            reached = reached.unionByName(frontier)
        return reached

    return site._once("depths", make)


def _cut(site: Site, frame: DataFrame) -> DataFrame:
    """The frame without its lineage, from the reliable checkpoint folder."""
    from ..sources.storage import checkpointed

    return checkpointed(site.spark, frame)
