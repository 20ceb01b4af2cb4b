"""Response time, weight and loading behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.quantiles import sketch_quantiles, sketches
from .registry import Category
from .tables import Site

checks = Category("Site Performance")

#: Limits and image endings of older formats.
SLOW_SECONDS, MOST_REQUESTS, MOST_TAGS, LARGE_BYTES = 2.5, 100, 1500, 2 * 1024 * 1024
LEGACY = r"\.(jpg|jpeg|png|gif|bmp)$"


def _unset_header(column: str) -> Column:
    return F.col("has_headers") & urls.blank(F.col(column)) & (F.col("crawl_status") == "Success")


@checks.page("C118", "Slow Response Time", "Warning")
def slow() -> Column:
    return F.col("crawl_time_s") > SLOW_SECONDS


@checks.page("C119", "Uncompressed HTML Response", "Warning")
def uncompressed() -> Column:
    return _unset_header("content_encoding")


@checks.page("C120", "Large HTML Document", "Notice", extra=True)
def large_html() -> Column:
    return F.octet_length("html") > LARGE_BYTES


@checks.page("C121", "Excessive Inferred Requests", "Notice")
def many_requests() -> Column:
    return F.col("h.n_requests") > MOST_REQUESTS


@checks.page("C122", "Render-Blocking Script", "Notice")
def blocking_script() -> Column:
    return F.exists("h.scripts", lambda s: s["in_head"] & s["src"].isNotNull() & ~s["deferred"])


@checks.page("C123", "Images Missing Dimensions", "Warning")
def unsized_image() -> Column:
    return F.exists("h.images", lambda i: ~i["sized"])


@checks.page("C124", "Legacy Image Formats", "Notice")
def legacy_image() -> Column:
    return F.exists("h.images", lambda i: F.lower(urls.path(F.coalesce(i["src"], F.lit("")))).rlike(LEGACY))


@checks.page("C125", "Unlazy Below-Fold Images", "Notice")
def unlazy_image() -> Column:
    """Every image after the first counts as below the fold."""
    later = F.slice("h.images", 2, F.greatest(F.size("h.images"), F.lit(1)))
    return F.exists(later, lambda i: F.lower(i["loading"]) != "lazy")


#: Field measurements that are still good (largest paint and next paint in ms, layout shift).
GOOD_VITALS = {"LCP": 2500.0, "INP": 200.0, "CLS": 0.1}


def vitals(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, p75, n, good: field measurements (keys, metric, value) judged at their 75th percentile, from mergeable sketches."""
    made = sketches(measured.where(F.col("metric").isin(*GOOD_VITALS)), [*keys, "metric"], "value")
    found = sketch_quantiles(made, [*keys, "metric"], 0.75, "p75").where("n > 0")
    limit = F.create_map(*[F.lit(x) for pair in GOOD_VITALS.items() for x in pair])[F.col("metric")]
    return found.withColumn("good", F.col("p75") <= limit)


@checks.site("C126", "Core Web Vitals", "Warning", extra=True)
def poor_vitals(site: Site) -> DataFrame:
    """Pages that visitors' measurements find slow or shifting."""
    return site.crawl.select("url").join(vitals(site.vitals, ["url"]).where("NOT good").select("url"), "url", "left_semi")


@checks.page("C127", "Excessive DOM Size", "Notice")
def large_dom() -> Column:
    return F.col("h.n_tags") > MOST_TAGS


@checks.page("C128", "Missing Caching Headers", "Notice")
def uncached() -> Column:
    return _unset_header("cache_control")
