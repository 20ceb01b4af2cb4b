"""Outgoing links, images and forms, and what probes found about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .crawlability import canonical
from .registry import Category
from .tables import On, Site

checks = Category("Links")

#: Tracking parameters, affiliate hosts, limits.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid".split()
AFFILIATES = (
    "amzn.to amazon. awin1.com shareasale.com cj.com clickbank.net rakuten linksynergy.com impact.com partnerize.com"
).split()
REPEATED_DEAD_LINKS, OUTBOUND_PER_WORD, OUTBOUND_LEAST = 3, 0.02, 5


def raw_hosts(condition) -> Column:
    """Whether a link's own (unresolved) host meets a condition."""
    return F.exists("h.anchors", lambda a: a["href"].isNotNull() & condition(a["href"], urls.netloc(a["href"]), a["rel"]))


def _probed(site: Site, condition: Column) -> DataFrame:
    probes = site.link_probe.where(condition).select(F.col("url").alias("target"))
    return site.external.select("url", "target").join(probes, "target", "left_semi")


@checks.site("C081", "Broken External Link", "Warning")
def broken_external(site: Site) -> On:
    return On("external", F.col("status") >= 400)


@checks.page("C082", "Insecure External Link", "Notice")
def insecure_external() -> Column:
    own = urls.netloc(F.col("url"))
    return raw_hosts(lambda href, host, rel: href.rlike("(?i)^http:") & (host != "") & (host != own))


@checks.site("C083", "External Link Redirect Chain", "Notice")
def redirected_external(site: Site) -> On:
    return On("external", F.col("redirected"))


@checks.site("C084", "External Resource Blocked By Robots", "Notice")
def blocked_external(site: Site) -> On:
    return On("external", F.col("robots_blocked"))


@checks.site("C085", "Broken Image Source", "Error")
def broken_image(site: Site) -> DataFrame:
    broken = site.image_probe.where("status >= 400").select(F.col("url").alias("target"))
    images = site.crawl.select("url", F.explode("h.images.absolute").alias("target")).where("target IS NOT NULL")
    return images.join(broken, "target", "left_semi")


@checks.page("C086", "Offsite Image Hosting", "Notice")
def offsite_image() -> Column:
    own = urls.netloc(F.col("url"))
    return F.exists("h.images", lambda i: (i["netloc"] != "") & (i["netloc"] != own))


@checks.site("C087", "Broken Favicon", "Notice", "Site")
def broken_favicon(site: Site) -> On:
    return site.everywhere(F.col("favicon_status") >= 400)


@checks.site("C088", "Broken Canonical Target", "Error")
def broken_canonical(site: Site) -> DataFrame:
    own = site.crawl.select("url", canonical().alias("target")).where("target <> ''")
    return own.join(site.status.where(urls.broken(F.col("target_status"))), "target", "left_semi")


@checks.site("C089", "Broken Hreflang Target", "Error")
def broken_hreflang(site: Site) -> DataFrame:
    targets = site.hreflang.select("url", F.trim("href").alias("target"))
    return targets.join(site.status.where(urls.broken(F.col("target_status"))), "target", "left_semi")


@checks.page("C090", "Tracking Parameters In Link", "Notice")
def tracking_link() -> Column:
    pattern = "(" + "|".join(TRACKING) + ")="
    return F.exists("h.anchors", lambda a: F.lower(urls.query(F.coalesce(a["href"], F.lit("")))).rlike(pattern))


@checks.site("C091", "Repeated Dead Outbound Link", "Warning", "Site")
def repeated_dead_link(site: Site) -> DataFrame:
    """Occurrences count, also several on one page."""
    dead = _probed(site, F.col("status") >= 400)
    often = dead.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED_DEAD_LINKS)
    return dead.join(often.select("target"), "target", "left_semi")


def repeated_dead_link_pages(site: Site) -> DataFrame:
    """As C091, counting referring pages."""
    dead = _probed(site, F.col("status") >= 400).distinct()
    often = dead.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED_DEAD_LINKS)
    return dead.join(often.select("target"), "target", "left_semi").select("url")


@checks.page("C092", "Excessive Outbound Links", "Notice")
def many_outbound() -> Column:
    own = urls.netloc(F.col("url"))
    host = lambda a: urls.netloc(F.coalesce(a["href"], F.lit("")))
    n = F.size(F.filter("h.anchors", lambda a: (host(a) != "") & (host(a) != own)))
    return (F.col("word_count") > 0) & (n >= OUTBOUND_LEAST) & (n / F.col("word_count") > OUTBOUND_PER_WORD)


@checks.page("C093", "Unmarked Affiliate Link", "Notice")
def unmarked_affiliate() -> Column:
    known = "|".join(a.replace(".", r"\.") for a in AFFILIATES)
    return raw_hosts(lambda href, host, rel: host.rlike(known) & ~rel.rlike("sponsored|nofollow"))


@checks.page("C094", "JavaScript Void Link", "Notice")
def javascript_link() -> Column:
    return F.exists("h.anchors", lambda a: F.lower(F.trim(F.coalesce(a["href"], F.lit("")))).startswith("javascript:"))


@checks.page("C095", "Insecure Form Action", "Warning")
def insecure_form() -> Column:
    return F.col("url").startswith("https://") & F.exists("h.actions", lambda a: a.startswith("http://"))
