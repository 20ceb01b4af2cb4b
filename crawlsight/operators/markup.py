"""Structured data, social tags, and head markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .amp import broken_rules
from .crawlability import has_rel
from .registry import Category
from .tables import Site

checks = Category("Markup & Structured Data")

#: Fields that a structured-data type needs.
REQUIRED = {
    "Organization": ["name"],
    "LocalBusiness": ["name", "address"],
    "Product": ["name"],
    "Article": ["headline"],
    "BlogPosting": ["headline"],
    "NewsArticle": ["headline"],
    "Person": ["name"],
    "WebSite": ["name"],
    "BreadcrumbList": ["itemListElement"],
}


def has_meta(name: str) -> Column:
    return F.exists("h.metas", lambda m: F.coalesce(m["name"] == name, F.lit(False)))


@checks.page("C108", "Missing Schema", "Notice")
def no_schema() -> Column:
    return urls.blank(F.col("schema"))


@checks.page("C109", "Invalid Structured Data", "Error")
def invalid_jsonld() -> Column:
    return F.col("h.jsonld_invalid")


@checks.page("C110", "Structured Data Missing Fields", "Warning")
def missing_fields() -> Column:
    def lacks(node: Column) -> Column:
        out = F.lit(False)
        for kind, needed in REQUIRED.items():
            absent = F.size(F.array_except(F.lit(needed), node["keys"])) > 0
            out = out | (F.array_contains(node["types"], kind) & absent)
        return out

    return F.exists("h.nodes", lacks)


@checks.page("C111", "Structured Data Type Mismatch", "Notice")
def product_without_image() -> Column:
    return F.col("schema").contains("Product") & (F.col("image_count") == 0)


@checks.page("C112", "Missing Open Graph Tags", "Notice")
def no_open_graph() -> Column:
    return urls.blank(F.col("og_title")) | urls.blank(F.col("og_description"))


@checks.page("C113", "Missing Twitter Card Tags", "Notice")
def no_twitter_card() -> Column:
    return ~has_meta("twitter:card")


@checks.page("C114", "AMP Page Missing Amphtml Link", "Notice", extra=True)
def no_amphtml() -> Column:
    """AMP pages without a link of the amphtml relation."""
    return F.col("is_amp") & ~F.col("has_amphtml")


@checks.site("C115", "AMP Validation", "Warning", extra=True)
def invalid_amp(site: Site) -> DataFrame:
    """AMP pages that break one of the rules of ``amp``; they alone are parsed again, for their elements."""
    return broken_rules(site.crawl.where("is_amp").select("url", "html")).select("url")


@checks.page("C116", "Missing Favicon Link", "Notice")
def no_icon() -> Column:
    return ~has_rel("(?i)icon")


@checks.page("C117", "Missing Viewport Meta", "Warning")
def no_viewport() -> Column:
    return ~has_meta("viewport")
