"""The tables that checks are written against: crawl, links, hreflang, redirects, site context."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import urls
from ..sources.storage import materialised

#: Hrefs that are no links.
SKIPPED = r"^(javascript:|mailto:|tel:|#)"


@dataclass(frozen=True)
class On:
    """A rule about what links of a table lead to: a condition on the columns of the target's row.

    Rules on one table are judged together, in one join: see ``Site.sides``.
    """

    table: str
    condition: Column


@dataclass
class Site:
    """A crawl with its context.

    ``crawl`` has the columns of FETCHED and PAGE and the struct ``h``; its urls
    are unique. Link and hreflang tables are written on first use, so that the rules
    that need them read narrow tables and explode no page again. ``as_of`` is what
    time-dependent checks take for now.
    """

    crawl: DataFrame
    context: DataFrame
    sitemap_urls: DataFrame
    sitemap_hreflang: DataFrame
    link_probe: DataFrame
    image_probe: DataFrame
    vitals: DataFrame
    as_of: datetime | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.crawl.sparkSession

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialised(self.spark, make(), name)
        return self._made[name]

    @property
    def status(self) -> DataFrame:
        """(target, target_status) of every crawled URL."""
        return self.crawl.select(F.col("url").alias("target"), F.col("status").alias("target_status"))

    @property
    def anchors(self) -> DataFrame:
        """One row per link of a page that is no script, mail, phone or fragment link."""

        def make() -> DataFrame:
            rows = self.crawl.select("url", urls.netloc(F.col("url")).alias("own"), F.explode("h.anchors").alias("a"))
            href = F.trim(F.col("a.href"))
            return rows.where((href != "") & ~href.rlike(SKIPPED)).select(
                "url", "own", F.col("a.absolute").alias("target"), F.col("a.netloc").alias("host"), "a.text", "a.rel"
            )

        return self._once("anchors", make)

    @property
    def internal(self) -> DataFrame:
        return self.anchors.where(F.col("host") == F.col("own"))

    @property
    def external(self) -> DataFrame:
        return self.anchors.where((F.col("host") != "") & (F.col("host") != F.col("own")))

    @property
    def hreflang(self) -> DataFrame:
        """(url, pos, code, href) of alternate links; code trimmed, href as it stands."""

        def make() -> DataFrame:
            rows = self.crawl.select("url", F.posexplode("h.rels").alias("pos", "k"))
            return rows.where(F.col("k.hreflang").isNotNull() & F.lower("k.rel").contains("alternate")).select(
                "url", "pos", F.trim("k.hreflang").alias("code"), F.col("k.href").alias("href")
            )

        return self._once("hreflang", make)

    @property
    def redirects(self) -> DataFrame:
        moved = urls.redirecting(F.col("status")) & (F.coalesce("redirect_target", F.lit("")) != "")
        return self.crawl.where(moved).select("url", F.col("redirect_target").alias("target"))

    def everywhere(self, condition: Column) -> On:
        """All URLs if the site context meets a condition."""
        return On("context", condition)

    def sides(self, table: str) -> tuple[DataFrame, DataFrame]:
        """(links with url and target, one row per target) of a table that rules can be ``On``."""
        target = F.col("url").alias("target")
        if table == "internal":
            return self.internal.select("url", "target"), self.status
        if table == "external":
            return self.external.select("url", "target"), self.link_probe.withColumnRenamed("url", "target")
        if table == "hreflang":
            return self.hreflang.select("url", F.col("href").alias("target")), self.crawl.select(target, "url", "status", "canonical_url")
        if table == "sitemap":
            return self.sitemap_urls.select("url", target), self.crawl.withColumn("target", F.col("url"))
        raise ValueError(f"no table {table}")

    def hits(self, rule: On | DataFrame) -> DataFrame:
        """The URLs that one rule affects."""
        if isinstance(rule, DataFrame):
            return rule.select("url")
        return self.flags({"": rule}).select("url")

    def flags(self, rules: dict[str, On]) -> DataFrame:
        """(check_id, url) of rules on one table, given by id.

        Conditions are judged on the targets' side, so only targets that fail a rule meet
        the links. The context is one row, so broadcasting it is bounded; URLs of the crawl
        are unique, so its rules need no distinct.
        """
        (table,) = {r.table for r in rules.values()}
        failing = F.filter(F.array(*[F.when(r.condition, F.lit(i)) for i, r in rules.items()]), lambda x: x.isNotNull()).alias("failing")
        some = F.size("failing") > 0
        if table == "context":
            one = self.context.limit(1).select(failing).where(some)
            return self.crawl.select("url").join(F.broadcast(one)).select(F.explode("failing").alias("check_id"), "url")
        links, targets = self.sides(table)
        marked = targets.select("target", failing).where(some)
        return links.join(marked, "target").select(F.explode("failing").alias("check_id"), "url").distinct()

    def now(self):
        return F.lit(self.as_of) if self.as_of else F.current_timestamp()


def site(
    crawl: DataFrame,
    context: DataFrame | None = None,
    sitemap_urls: DataFrame | None = None,
    sitemap_hreflang: DataFrame | None = None,
    link_probe: DataFrame | None = None,
    image_probe: DataFrame | None = None,
    as_of: datetime | None = None,
    vitals: DataFrame | None = None,
) -> Site:
    """A Site; what is not given is empty. Without a context nothing is known about robots.txt, sitemap or TLS.

    Header checks say nothing about a crawl in which no page succeeded: ``has_headers`` tells.
    """
    spark = crawl.sparkSession
    some = crawl.agg(F.coalesce(F.bool_or(F.col("crawl_status") == "Success"), F.lit(False)).alias("has_headers"))
    crawl = crawl.drop("has_headers").join(F.broadcast(some))

    def empty(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema)

    if context is None:
        blank = (None, None, None, False, False, None, None, None, None, False, False)
        context = spark.createDataFrame([blank], schemas.SITE)
    return Site(
        crawl,
        context,
        empty(schemas.SITEMAP_URLS) if sitemap_urls is None else sitemap_urls,
        empty(schemas.SITEMAP_HREFLANG) if sitemap_hreflang is None else sitemap_hreflang,
        empty(schemas.LINK_PROBE) if link_probe is None else link_probe,
        empty(schemas.IMAGE_PROBE) if image_probe is None else image_probe,
        empty(schemas.VITALS) if vitals is None else vitals,
        as_of,
    )
