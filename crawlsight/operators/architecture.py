"""Site architecture: internal links, anchors and click depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.quantiles import exact_quantiles
from .crawlability import has_rel
from .graph import click_depths
from .redirects import links_to
from .registry import Category
from .tables import On, Site

checks = Category("Site Architecture & Internal Linking")

#: Anchor texts and words that say nothing, limits.
GENERIC = ("click here", "read more", "learn more", "here", "more", "link", "this page", "more info")
ANCHOR_STOP_WORDS = (
    "the and for with this that from your here more page read click learn about into over than"
).split()
MOST_LINKS, DEEP, DEEPER, BREADCRUMB_DEPTH = 100, 3, 5, 2
ANOMALY_SHARE, ANOMALY_PAGES = 0.3, 5


def significant_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(ANCHOR_STOP_WORDS)))


def own_links() -> Column:
    """A row's internal links, from its anchors."""
    own = urls.netloc(F.col("url"))
    href = lambda a: F.trim(a["href"])
    return F.filter(
        "h.anchors",
        lambda a: a["href"].isNotNull()
        & (href(a) != "")
        & ~href(a).rlike(r"^(javascript:|mailto:|tel:|#)")
        & (a["netloc"] == own),
    )


@checks.site("C066", "Orphan Pages", "Error", "Site")
def orphans(site: Site) -> DataFrame:
    """URLs that no page names in an absolute href, as it stands; relative links and the sitemap don't count."""
    named = site.crawl.select(F.explode("h.anchors.href").alias("url")).where(F.col("url").rlike("^https?://"))
    return site.crawl.select("url").join(named, "url", "left_anti")


def orphans_resolved(site: Site) -> DataFrame:
    """URLs of crawl or sitemap that no resolved internal link of another page reaches."""
    known = site.crawl.select("url").union(site.sitemap_urls.select("url")).distinct()
    reached = site.internal.where("url <> target").select(urls.normalised(F.col("target")).alias("url"))
    return known.join(reached, "url", "left_anti")


@checks.site("C067", "Excessive Click Depth", "Warning", "Site")
def deep(site: Site) -> DataFrame:
    return click_depths(site).where(F.col("depth") > DEEP)


@checks.site("C068", "Severe Click Depth", "Error", "Site")
def deeper(site: Site) -> DataFrame:
    return click_depths(site).where(F.col("depth") > DEEPER)


@checks.site("C069", "Too Few Internal Links", "Warning", "Site", extra=True)
def few_inlinks(site: Site) -> DataFrame:
    """Pages of the sitemap, or of the crawl without a sitemap, that fewer than two other pages link to."""
    has_map = site.sitemap_urls.limit(1).select(F.lit(True).alias("mapped"))
    pages = site.crawl.select("url").join(F.broadcast(has_map), how="left")
    listed = site.sitemap_urls.select("url", F.lit(True).alias("listed")).distinct()
    important = pages.join(listed, "url", "left").where("mapped IS NULL OR listed").select("url")
    inlinks = site.internal.where("url <> target").groupBy(F.col("target").alias("url")).agg(F.countDistinct("url").alias("n"))
    return important.join(inlinks, "url", "left").where(F.coalesce("n", F.lit(0)) < 2)


@checks.page("C070", "Excessive Internal Links", "Notice")
def many_links() -> Column:
    return F.size(own_links()) > MOST_LINKS


@checks.site("C071", "Broken Internal Link", "Error")
def broken_link(site: Site) -> On:
    return links_to(urls.broken(F.col("target_status")))


@checks.site("C072", "Internal Link To Redirect", "Warning")
def link_to_redirect(site: Site) -> On:
    return links_to(urls.redirecting(F.col("target_status")))


@checks.page("C073", "Internal Link Nofollow", "Notice")
def nofollow_link() -> Column:
    return F.exists(own_links(), lambda a: a["rel"].contains("nofollow"))


@checks.page("C074", "Generic Anchor Text", "Notice")
def generic_anchor() -> Column:
    return F.exists(own_links(), lambda a: F.lower(F.trim(a["text"])).isin("", *GENERIC))


@checks.site("C075", "Anchor Text Mismatch", "Notice")
def anchor_mismatch(site: Site) -> DataFrame:
    topics = site.crawl.select(
        F.col("url").alias("target"), significant_words(F.concat_ws(" ", "title", "h1")).alias("topic")
    ).where("size(topic) > 0")
    links = site.internal.select("url", "target", significant_words(F.col("text")).alias("words")).where("size(words) > 0")
    return links.distinct().join(topics, "target").where(~F.arrays_overlap("words", "topic"))


@checks.page("C076", "Low Internal Link Support", "Warning", "Site")
def few_links() -> Column:
    """Distinct outgoing internal links; see ``low_inlinks`` for incoming ones."""
    return F.col("internal_links") <= 1


def low_inlinks(site: Site) -> DataFrame:
    """Pages that at most one other page links to."""
    inlinks = site.internal.where("url <> target").groupBy(F.col("target").alias("url")).agg(F.countDistinct("url").alias("n"))
    return site.crawl.select("url").join(inlinks, "url", "left").where(F.coalesce("n", F.lit(0)) <= 1).select("url")


@checks.site("C077", "Navigation Link Count Anomaly", "Notice", "Site")
def link_anomaly(site: Site) -> DataFrame:
    counts = site.crawl.select("url", F.size(own_links()).alias("n"))
    usual = exact_quantiles(counts, [], "n", name="usual")
    usual = usual.where((F.col("n") >= ANOMALY_PAGES) & (F.col("usual") > 0)).select("usual")
    return counts.join(F.broadcast(usual)).where(F.col("n") < F.col("usual") * ANOMALY_SHARE)


@checks.site("C078", "Breadcrumb Missing On Deep Page", "Notice")
def no_breadcrumb(site: Site) -> DataFrame:
    far = click_depths(site).where(F.col("depth") > BREADCRUMB_DEPTH).select("url")
    return site.crawl.where(~F.col("h.has_breadcrumb")).select("url").join(far, "url", "left_semi")


@checks.page("C079", "Pagination Missing First/Last", "Notice")
def no_first_last() -> Column:
    return has_rel(r"(?iU)\b(next|prev)\b") & ~has_rel(r"(?iU)\b(first|last)\b")


@checks.site("C080", "Subdomain Without Cross-Links", "Notice", "Site", extra=True)
def isolated_hosts(site: Site) -> DataFrame:
    """Pages of hosts that no link joins with another crawled host, if the crawl has several hosts."""
    pages = site.crawl.select("url", urls.netloc(F.col("url")).alias("host"))
    hosts = pages.select("host").distinct()
    cross = site.external.select("own", "host").distinct().join(hosts, "host", "left_semi")
    joined = cross.select("host").union(cross.select(F.col("own").alias("host"))).distinct()
    several = hosts.agg(F.count("*").alias("hosts")).where("hosts > 1")
    return pages.join(joined, "host", "left_anti").join(F.broadcast(several))
