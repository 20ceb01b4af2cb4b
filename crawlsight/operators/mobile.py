"""Mobile use and accessibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import has_meta
from .registry import Category

checks = Category("Mobile & Accessibility")

#: Links per 100 words, and links, from which on tap targets count as dense.
DENSE_PER_100_WORDS, DENSE_LEAST = 8, 10


@checks.page("C129", "Missing Viewport Meta (Mobile)", "Warning")
def no_viewport() -> Column:
    return ~has_meta("viewport")


@checks.page("C130", "Images Missing Alt Text", "Warning")
def no_alt() -> Column:
    return F.exists("h.images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")


@checks.page("C131", "Empty Alt Attribute", "Notice")
def empty_alt() -> Column:
    return F.exists("h.images", lambda i: i["alt"].isNotNull() & (F.trim(i["alt"]) == ""))


@checks.page("C132", "Dense Tap Targets", "Notice")
def dense_links() -> Column:
    n = F.size("h.anchors")
    words = F.col("word_count")
    return (F.coalesce("html", F.lit("")) != "") & (words > 0) & (n >= DENSE_LEAST) & (n / words * 100 > DENSE_PER_100_WORDS)


@checks.page("C133", "Text Likely Too Small", "Notice", extra=True)
def small_text() -> Column:
    """Pages with HTML that set neither a viewport nor any font size."""
    return (F.coalesce("html", F.lit("")) != "") & ~has_meta("viewport") & ~F.col("has_font_size")


@checks.page("C134", "Form Fields Missing Label", "Warning")
def unlabelled_field() -> Column:
    return F.col("h.unlabelled")


@checks.page("C135", "Color Contrast Unverified", "Notice", extra=True)
def unverified_contrast() -> Column:
    """Contrast can't be told without rendering: every page with HTML is marked as unverified."""
    return F.coalesce("html", F.lit("")) != ""
