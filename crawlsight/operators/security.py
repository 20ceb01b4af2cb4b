"""HTTPS and security headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .registry import Category
from .tables import On, Site

checks = Category("HTTPS & Security")

#: Days before the end of a certificate's life that count as soon.
EXPIRY_DAYS = 30


def is_https() -> Column:
    return F.col("url").startswith("https://")


@checks.page("C021", "Non-HTTPS Pages", "Error", "Site")
def not_https() -> Column:
    return ~is_https()


@checks.site("C022", "HTTP URLs In Sitemap", "Error", "Site")
def http_in_sitemap(site: Site) -> DataFrame:
    some = site.sitemap_urls.where(F.col("url").startswith("http://")).limit(1).select(F.lit(1).alias("_one"))
    return site.crawl.select("url").join(F.broadcast(some))


@checks.page("C023", "Mixed Content", "Error")
def mixed_content() -> Column:
    plain = lambda x: F.coalesce(x.startswith("http://"), F.lit(False))
    return is_https() & (
        F.exists("h.images", lambda i: plain(i["src"]))
        | F.exists("h.scripts", lambda s: plain(s["src"]))
        | F.exists("h.rels", lambda k: plain(k["href"]))
    )


@checks.page("C024", "No HTTP-To-HTTPS Redirect", "Error", "Site")
def no_upgrade() -> Column:
    upgraded = urls.redirecting(F.col("status")) & F.coalesce(F.col("redirect_target").startswith("https://"), F.lit(False))
    return F.col("url").startswith("http://") & ~upgraded


@checks.page("C025", "Missing HSTS Header", "Warning", "Site")
def no_hsts() -> Column:
    return F.col("has_headers") & is_https() & urls.blank(F.col("strict_transport_security"))


@checks.site("C026", "SSL Certificate Expired", "Error", "Site")
def certificate_expired(site: Site) -> On:
    ended = F.coalesce(F.col("ssl_info.not_after") < site.now(), F.lit(False))
    return site.everywhere(F.coalesce("ssl_info.expired", F.lit(False)) | ended)


@checks.site("C027", "SSL Certificate Expiring Soon", "Warning", "Site")
def certificate_expiring(site: Site) -> On:
    end, now = F.col("ssl_info.not_after"), site.now()
    return site.everywhere((now <= end) & (end < now + F.expr(f"INTERVAL {EXPIRY_DAYS} DAYS")))


@checks.site("C028", "SSL Certificate Hostname Mismatch", "Error", "Site")
def certificate_host(site: Site) -> On:
    return site.everywhere(F.col("ssl_info.checked") & (F.col("ssl_info.hostname_matches") == False))  # noqa: E712


@checks.page("C030", "Missing Security Headers", "Notice")
def no_security_headers() -> Column:
    blank = [urls.blank(F.col(c)) for c in ("x_content_type_options", "x_frame_options", "content_security_policy")]
    return F.col("has_headers") & blank[0] & blank[1] & blank[2]
