"""The health report: checks to findings, category scores, overall score, grade and quick wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import (  # noqa: F401  importing registers the checks
    architecture,
    crawlability,
    international,
    links,
    markup,
    mobile,
    on_page,
    performance,
    redirects,
    security,
)
from ..operators.registry import CATEGORIES, CATEGORY_WEIGHT, CHECKS, SEVERITY_WEIGHTS, Check
from ..operators.tables import On, Site

#: The order in which findings are listed; it decides ties among quick wins.
EVALUATION_ORDER = (
    "C066 C021 C031 C044 C048 C051 C054 C041 C045 C049 C056 C042 C043 C046 C047 C050 C059 C052 C062 C065 C064 C061 "
    "C058 C053 C076 C108 C112 C116 C113 C109 C118 C123 C127 C124 C060 C063 C082 C086 C094 C121 C122 C129 C134 C012 "
    "C013 C015 C018 C023 C036 C037 C038 C070 C071 C072 C073 C074 C088 C092 C095 C096 C101 C102 C106 C014 C017 C019 "
    "C020 C067 C068 C077 C078 C079 C089 C090 C097 C098 C100 C104 C110 C111 C125 C131 C132 C001 C002 C003 C004 C005 "
    "C006 C007 C008 C009 C010 C024 C025 C030 C032 C034 C035 C039 C075 C093 C099 C016 C022 C026 C027 C028 C103 C105 "
    "C107 C119 C128 C081 C083 C084 C085 C087 C091 C117 C130"
).split()


def checks(category: str | None = None, extra: bool = False) -> list[Check]:
    """The registered checks; ``extra`` adds those beyond the report's own."""
    wanted = [c for c in CHECKS.values() if category in (None, c.category) and (extra or not c.extra)]
    return sorted(wanted, key=lambda c: c.check_id)


def catalog(spark: SparkSession) -> DataFrame:
    """(check_id, check, category, severity, level, weight, place) of the report's checks."""
    rows = [
        (c.check_id, c.name, c.category, c.severity, c.level, SEVERITY_WEIGHTS[c.severity], EVALUATION_ORDER.index(c.check_id))
        for c in checks()
    ]
    return spark.createDataFrame(
        rows, "check_id string, check string, category string, severity string, level string, weight int, place int"
    )


def page_flags(crawl: DataFrame, wanted: list[Check]) -> DataFrame:
    """(check_id, url) of all page rules, in one pass and without a shuffle; works on streams as well.

    The filter that a plain explode implies would be pushed below the rules and judge them once more.
    """
    failing = F.filter(F.array(*[F.when(c.rule(), F.lit(c.check_id)) for c in wanted]), lambda x: x.isNotNull())
    return crawl.select("url", failing.alias("failing")).select(F.explode_outer("failing").alias("check_id"), "url").where("check_id IS NOT NULL")


def flags(site: Site, wanted: list[Check]) -> DataFrame:
    """(check_id, url) of all affected URLs, each once; URLs that the crawl repeats are repeated by rules on its rows."""
    per_page = [c for c in wanted if c.per_page]
    frames = [page_flags(site.crawl, per_page)] if per_page else []  # URLs of the crawl are unique
    found = {c.check_id: c.rule(site) for c in wanted if not c.per_page}
    on = {i: r for i, r in found.items() if isinstance(r, On)}
    for table in sorted({r.table for r in on.values()}):
        frames.append(site.flags({i: r for i, r in on.items() if r.table == table}))
    rows = {c.check_id for c in wanted if c.of_rows}
    plain = {i: r.select(F.lit(i).alias("check_id"), "url") for i, r in found.items() if i not in on}
    frames += [r if i in rows else r.distinct() for i, r in plain.items()]
    return reduce(DataFrame.unionByName, frames)


def findings(site: Site) -> DataFrame:
    """One row per triggered check: counts, deduction (4 decimals) and impact."""
    counted = flags(site, checks()).groupBy("check_id").agg(F.count("*").alias("affected_pages"))
    total = site.crawl.agg(F.count("*").alias("pages"))
    return (
        counted.join(F.broadcast(catalog(site.spark)), "check_id")
        .join(F.broadcast(total))
        .select(
            "check_id",
            "category",
            "check",
            "severity",
            "affected_pages",
            F.round(F.col("affected_pages") / F.col("pages") * F.col("weight"), 4).alias("deduction"),
            (F.col("affected_pages") * F.col("weight")).cast("long").alias("impact_score"),
            "place",
        )
    )


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1))).cast("int")


def category_scores(found: DataFrame, per_check: bool = False) -> DataFrame:
    """(category, weight, score, label) of all ten categories.

    The mean deduction runs over triggered checks; ``per_check`` takes all checks
    of the category instead.
    """
    spark = found.sparkSession
    sizes = {name: len(checks(name)) for name in CATEGORIES}
    rows = [(name, CATEGORY_WEIGHT, label, sizes[name]) for name, label in CATEGORIES.items()]
    base = spark.createDataFrame(rows, "category string, weight int, label string, checks int")
    sums = found.groupBy("category").agg(F.sum("deduction").alias("lost"), F.count("*").alias("hits"))
    over = F.col("checks") if per_check else F.col("hits")
    score = F.when(F.col("hits").isNull(), F.lit(100)).otherwise(_clamped(100 - F.col("lost") / over * 100))
    return F.broadcast(base).join(sums, "category", "left").select("category", "weight", score.alias("score"), "label")


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    )


def health(site: Site, found: DataFrame | None = None) -> DataFrame:
    """One row: health_score, grade, pages_crawled, issues_found. An empty crawl scores 100."""
    found = findings(site) if found is None else found
    score = F.bround(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("int")
    overall = category_scores(found).agg(score.alias("health_score"))
    pages = site.crawl.agg(F.count("*").alias("pages_crawled"))
    issues = found.agg(F.count("*").alias("issues_found"))
    return (
        overall.join(F.broadcast(pages))
        .join(F.broadcast(issues))
        .select("health_score", grade(F.col("health_score")).alias("grade"), "pages_crawled", "issues_found")
    )


def quick_wins(found: DataFrame) -> DataFrame:
    """Findings by impact, then affected pages; at most one row per check."""
    order = Window.orderBy(F.col("impact_score").desc(), F.col("affected_pages").desc(), "place")
    return found.select(
        F.col("check").alias("issue"),
        F.col("impact_score").alias("impact"),
        "affected_pages",
        "category",
        F.row_number().over(order).alias("priority"),
    )


def trend(history: DataFrame) -> DataFrame:
    """(audit_ts, health_score, previous_score, change) of past audits of each site."""
    order = Window.partitionBy("site").orderBy("audit_ts")
    before = F.lag("health_score").over(order)
    return history.select(
        "site", "audit_ts", "health_score", before.alias("previous_score"), (F.col("health_score") - before).alias("change")
    )
