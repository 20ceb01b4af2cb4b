"""The catalog of checks: id, name, category, severity, level, and how each is evaluated.

A page rule is a condition on one crawl row. All page rules are evaluated in one
pass over the crawl: the rows' failing ids are one array that is exploded. A site
rule is a function from Site to a frame with the URLs it affects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .tables import On, Site

#: Severities with weights, categories with labels (each category weighs 10).
SEVERITY_WEIGHTS = {"Error": 3, "Warning": 2, "Notice": 1}
CATEGORIES = {
    "Crawlability & Indexability": "crawlability",
    "HTTPS & Security": "security",
    "Redirects": "redirects",
    "On-Page & Duplicates": "on_page",
    "Site Architecture & Internal Linking": "architecture",
    "Links": "links",
    "International SEO": "international",
    "Markup & Structured Data": "markup",
    "Site Performance": "performance",
    "Mobile & Accessibility": "mobile",
}
CATEGORY_WEIGHT = 10


@dataclass(frozen=True)
class Check:
    check_id: str
    name: str
    category: str
    severity: str
    level: str
    rule: Callable[[], Column] | Callable[[Site], DataFrame | On]
    per_page: bool
    extra: bool = False
    of_rows: bool = False


CHECKS: dict[str, Check] = {}


class Category:
    """Registers the checks of one category."""

    def __init__(self, category: str):
        if category not in CATEGORIES:
            raise ValueError(f"unknown category {category}")
        self.category = category

    def _add(self, check_id, name, severity, level, per_page, extra, of_rows=False):
        def register(rule):
            if check_id in CHECKS:
                raise ValueError(f"{check_id} is registered twice")
            CHECKS[check_id] = Check(check_id, name, self.category, severity, level, rule, per_page, extra, of_rows)
            return rule

        return register

    def page(self, check_id: str, name: str, severity: str, level: str = "Page", extra: bool = False):
        """A condition on one crawl row; null counts as not affected."""
        return self._add(check_id, name, severity, level, True, extra)

    def site(self, check_id: str, name: str, severity: str, level: str = "Page", extra: bool = False, of_rows: bool = False):
        """A function that returns a frame with the column url, whose repeats don't matter, or a rule on a table of links.

        With ``of_rows`` the frame has one row per affected row of the crawl, so that two pages of one
        URL are two, as they are to page rules, and nothing is made distinct.
        """
        return self._add(check_id, name, severity, level, False, extra, of_rows)
