"""Titles, descriptions, headings, duplicates and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .registry import Category
from .tables import Site

checks = Category("On-Page & Duplicates")

#: Limits of lengths and shares.
TITLE_LENGTH, DESCRIPTION_LENGTH = (30, 60), (70, 160)
THIN_WORDS, TEXT_SHARE, URL_LENGTH, URL_PARAMETERS = 300, 0.10, 115, 3


def sharing(pages: DataFrame, value: Column) -> DataFrame:
    """(url, value) of all rows whose non-blank value another row has too.

    Values are counted with partial aggregation and joined back, so that a value
    which most pages share is no hot window partition.
    """
    rows = pages.select("url", value.alias("value")).where(~urls.blank(F.col("value")))
    again = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return rows.join(again, "value", "left_semi").select("url", "value")


def duplicates(pages: DataFrame, value: Column) -> DataFrame:
    """(url, value) of rows whose non-blank value another row has too, each once."""
    return sharing(pages, value).distinct()


def content_hash() -> Column:
    """SHA-1 of the lower-cased text with single blanks; '' for none."""
    text = F.trim(F.regexp_replace(F.coalesce("content_text", F.lit("")), r"(?U)\s+", " "))
    return F.when(text == "", F.lit("")).otherwise(F.sha1(F.lower(text)))


@checks.page("C041", "Missing Title", "Error")
def no_title() -> Column:
    return urls.blank(F.col("title"))


@checks.page("C042", "Title Too Short", "Warning")
def title_short() -> Column:
    return (F.length("title") > 0) & (F.length("title") < TITLE_LENGTH[0])


@checks.page("C043", "Title Too Long", "Warning")
def title_long() -> Column:
    return F.length("title") > TITLE_LENGTH[1]


@checks.site("C044", "Duplicate Titles", "Error", "Site", of_rows=True)
def same_title(site: Site) -> DataFrame:
    return sharing(site.crawl, F.col("title"))


@checks.page("C045", "Missing Description", "Warning")
def no_description() -> Column:
    return urls.blank(F.col("description"))


@checks.page("C046", "Meta Description Too Short", "Notice")
def description_short() -> Column:
    return (F.length("description") > 0) & (F.length("description") < DESCRIPTION_LENGTH[0])


@checks.page("C047", "Meta Description Too Long", "Notice")
def description_long() -> Column:
    return F.length("description") > DESCRIPTION_LENGTH[1]


@checks.site("C048", "Duplicate Meta Descriptions", "Warning", "Site", of_rows=True)
def same_description(site: Site) -> DataFrame:
    return sharing(site.crawl, F.col("description"))


@checks.page("C049", "Missing H1", "Error")
def no_h1() -> Column:
    return urls.blank(F.col("h1"))


@checks.page("C050", "Multiple H1s", "Warning")
def several_h1() -> Column:
    return F.size(F.filter("h.levels", lambda x: x == 1)) > 1


@checks.site("C051", "Duplicate H1 Tags", "Warning", "Site", of_rows=True)
def same_h1(site: Site) -> DataFrame:
    return sharing(site.crawl, F.col("h1"))


@checks.page("C052", "H1 Duplicates Title", "Notice")
def h1_is_title() -> Column:
    return ~urls.blank(F.col("title")) & (F.trim("title") == F.trim("h1"))


@checks.page("C053", "Thin Content", "Warning")
def thin() -> Column:
    return F.col("word_count") < THIN_WORDS


@checks.site("C054", "Duplicate Body Content", "Error", "Site", of_rows=True)
def same_body(site: Site) -> DataFrame:
    return sharing(site.crawl, content_hash())


@checks.site("C055", "Exact Duplicate Page", "Error", "Site", extra=True, of_rows=True)
def same_html(site: Site) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return sharing(site.crawl, F.when(html == "", F.lit("")).otherwise(F.sha1(html)))


@checks.page("C056", "Missing Canonical", "Warning")
def no_canonical() -> Column:
    return urls.blank(F.col("canonical_url"))


@checks.site("C057", "Keyword Cannibalization", "Warning", "Site", extra=True, of_rows=True)
def cannibalization(site: Site) -> DataFrame:
    """Pages whose whole title and whole H1 name the same words as another page's, in any order."""
    words = F.array_sort(
        F.array_distinct(
            F.filter(
                F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "h1")), F.lit(r"[a-z0-9]+"), F.lit(0)),
                lambda w: F.length(w) >= 4,
            )
        )
    )
    return sharing(site.crawl, F.array_join(words, " "))


@checks.page("C058", "Low Text-to-HTML Ratio", "Notice")
def low_text_ratio() -> Column:
    return (F.coalesce("html", F.lit("")) != "") & (F.length("h.body_text") / F.length("html") < TEXT_SHARE)


@checks.page("C059", "Missing Language Declaration", "Notice")
def no_language() -> Column:
    return F.col("h.lang") == ""


@checks.page("C060", "Broken Heading Hierarchy", "Notice")
def heading_skip() -> Column:
    """A heading more than one level below the deepest level so far."""
    start = F.struct(F.lit(0).alias("deepest"), F.lit(False).alias("skipped"))

    def step(state: Column, level: Column) -> Column:
        skip = (state["deepest"] > 0) & (level > state["deepest"] + 1)
        return F.struct(
            F.greatest(state["deepest"], level).alias("deepest"), (state["skipped"] | skip).alias("skipped")
        )

    return F.aggregate("h.levels", start, step)["skipped"]


@checks.page("C061", "URL Excessive Parameters", "Notice")
def many_parameters() -> Column:
    return urls.query_keys(F.col("url")) > URL_PARAMETERS


@checks.page("C062", "URL Too Long", "Notice")
def url_long() -> Column:
    return F.length("url") > URL_LENGTH


@checks.page("C063", "Non-Descriptive URL", "Notice")
def url_number() -> Column:
    path = F.regexp_replace(urls.path(F.col("url")), "/+$", "")
    return F.substring_index(path, "/", -1).rlike(r"(?i)^(\d+|[0-9a-f]{8,})$")


@checks.page("C064", "URL Contains Underscores", "Notice")
def url_underscore() -> Column:
    return F.col("url").contains("_")


@checks.page("C065", "URL Contains Uppercase", "Notice")
def url_upper() -> Column:
    return F.col("url").rlike(r"\p{Lu}")
