"""Hreflang clusters and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .registry import Category
from .tables import On, Site

checks = Category("International SEO")

#: Valid codes; frequent words per language, in the order that decides ties.
CODE = r"^([a-zA-Z]{2,3}(-[a-zA-Z]{2,8})?|x-default)$"
STOP_WORDS = {
    "en": "the and of to in is for that this with are was on as",
    "es": "el la de que en los del las por con una para como",
    "fr": "le la de et les des est que pour dans une sur avec",
    "de": "der die und das den ist mit von auf für dem ein eine",
    "pt": "de que com para uma por dos das como mais seu sua",
    "it": "il di che la per con una del gli alla non sono",
}
LEAST_WORDS, LEAST_SHARE = 20, 0.08


def codes() -> Column:
    """The non-empty codes of a row's alternate links, trimmed."""
    alternate = F.filter(
        "h.rels", lambda k: k["hreflang"].isNotNull() & F.lower(k["rel"]).contains("alternate")
    )
    return F.filter(F.transform(alternate, lambda k: F.trim(k["hreflang"])), lambda c: c != "")


def _entries() -> Column:
    return F.filter("h.rels", lambda k: k["hreflang"].isNotNull() & F.lower(k["rel"]).contains("alternate"))


def primary(code: Column) -> Column:
    return F.substring_index(F.lower(code), "-", 1)


@checks.page("C096", "Invalid Hreflang Code", "Error")
def invalid_code() -> Column:
    return F.exists(codes(), lambda c: ~c.rlike(CODE))


@checks.site("C097", "Hreflang Missing Return Link", "Error")
def no_return_link(site: Site) -> DataFrame:
    pairs = site.hreflang.where("href <> ''").select("url", "href").distinct()
    crawled = pairs.where("href <> url").join(site.crawl.select(F.col("url").alias("href")), "href", "left_semi")
    back = pairs.select(F.col("href").alias("url"), F.col("url").alias("href"))
    return crawled.join(back, ["url", "href"], "left_anti")


@checks.site("C098", "Hreflang Points To Non-Canonical", "Warning")
def to_non_canonical(site: Site) -> On:
    own = F.trim(F.coalesce("canonical_url", F.lit("")))
    return On("hreflang", (own != "") & (own != F.col("url")))


@checks.site("C099", "Hreflang Points To Redirect", "Warning")
def to_redirect(site: Site) -> On:
    return On("hreflang", urls.redirecting(F.col("status")))


@checks.site("C100", "Hreflang Points To Broken URL", "Error")
def to_broken(site: Site) -> On:
    return On("hreflang", urls.broken(F.col("status")))


@checks.page("C101", "Multiple X-Default Hreflang", "Warning")
def several_defaults() -> Column:
    return F.size(F.filter(codes(), lambda c: F.lower(c) == "x-default")) > 1


@checks.page("C102", "Missing X-Default Hreflang", "Notice")
def no_default() -> Column:
    return (F.size(_entries()) >= 2) & ~F.exists(codes(), lambda c: F.lower(c) == "x-default")


@checks.site("C103", "Hreflang Cluster Inconsistent", "Warning", "Site")
def inconsistent_cluster(site: Site) -> DataFrame:
    """Pages whose set of alternates, themselves included, differs from that of a crawled member."""
    targets = site.hreflang.where("href <> ''").groupBy("url").agg(F.collect_set("href").alias("targets"))
    own = site.crawl.select("url").join(targets, "url", "left").select(
        "url",
        F.array_sort(F.array_union(F.coalesce("targets", F.array().cast("array<string>")), F.array("url"))).alias("cluster"),
        F.col("targets").isNotNull().alias("declares"),
    )
    members = own.where("declares").select("url", "cluster", F.explode("cluster").alias("member"))
    other = own.select(F.col("url").alias("member"), F.col("cluster").alias("theirs"))
    return members.join(other, "member").where("cluster <> theirs")


@checks.page("C104", "Hreflang Language Conflict", "Notice")
def language_conflict() -> Column:
    code = lambda k: F.trim(k["hreflang"])
    return (F.col("h.lang") != "") & F.exists(
        _entries(),
        lambda k: (k["href"] == F.col("url"))
        & (code(k) != "")
        & (F.lower(code(k)) != "x-default")
        & (primary(code(k)) != primary(F.col("h.lang"))),
    )


@checks.site("C105", "Hreflang Sitemap Disagreement", "Warning", "Site")
def sitemap_disagreement(site: Site) -> DataFrame:
    """Of repeated codes on a page the last counts; pages without annotations in the sitemap are left out."""
    last = site.hreflang.where("code <> ''").groupBy("url", F.lower("code").alias("code")).agg(F.max_by("href", "pos").alias("href"))
    here = last.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("code", "href"))).alias("here"))
    there = site.sitemap_hreflang.groupBy("url").agg(
        F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "href")))).alias("there")
    )
    both = site.crawl.select("url").join(there, "url").join(here, "url", "left")
    none = F.array().cast("array<struct<code:string,href:string>>")
    return both.where(F.coalesce("here", none) != F.col("there"))


@checks.page("C106", "Duplicate Hreflang", "Warning")
def duplicate_code() -> Column:
    low = F.transform(codes(), lambda c: F.lower(c))
    return F.size(low) != F.size(F.array_distinct(low))


def detected_language(text: Column) -> Column:
    """struct(language, share): the language whose frequent words make up most of a text; null below 20 words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))

    def best(words: Column) -> Column:
        def score(rank: int, language: str) -> Column:
            share = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[language].split()))) / F.size(words)
            return F.struct(share.alias("share"), F.lit(-rank).alias("rank"), F.lit(language).alias("language"))

        scores = F.array(*[score(rank, language) for rank, language in enumerate(STOP_WORDS)])
        return F.when(F.size(words) >= LEAST_WORDS, F.array_max(scores))

    # Lambdas' variables stand for the words and for the best score, which are made once.
    scored = F.transform(F.array(found), best)
    told = F.transform(scored, lambda b: F.when(b["share"] > 0, F.struct(b["language"].alias("language"), b["share"].alias("share"))))
    return F.get(told, F.lit(0))


@checks.page("C107", "Content Language Mismatch", "Notice")
def language_mismatch() -> Column:
    other = lambda found: (found["share"] >= LEAST_SHARE) & (found["language"] != primary(F.col("h.lang")))
    return primary(F.col("h.lang")).isin(*STOP_WORDS) & F.exists(F.array(detected_language(F.col("h.text"))), other)
