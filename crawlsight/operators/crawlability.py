"""Crawlability and indexability: robots, sitemap, canonical and pagination signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.robots import blocked_paths
from .registry import Category
from .tables import On, Site

checks = Category("Crawlability & Indexability")

#: Words of an error page, asset paths, pagination URLs, and robots.txt directives.
NOT_FOUND = r"(?iU)\b(page not found|404 error|error 404|not found|doesn't exist|does not exist)\b"
SOFT_404_WORDS = 200
ASSETS = r"(?i)\.(css|js)(\?|$)|/(assets|static|wp-content|wp-includes)/"
PAGINATION = r"(?i)[?&](?:page|p)=\d+|/page/\d+"
DIRECTIVES = ("user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host")


def robots_meta() -> Column:
    """Lower-cased content of the page's first robots meta tag; '' without one."""
    found = F.filter("h.metas", lambda m: F.lower(m["name"]) == "robots")
    return F.coalesce(F.lower(F.try_element_at(found, F.lit(1))["content"]), F.lit(""))


def has_rel(pattern: str) -> Column:
    return F.exists("h.rels", lambda k: k["rel"].rlike(pattern))


def canonical() -> Column:
    return F.trim(F.coalesce("canonical_url", F.lit("")))


def _lines(text: Column) -> Column:
    """(directive, value) of robots.txt lines with a colon, in order, comments and blanks left out."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x))
    wanted = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    return F.transform(
        wanted,
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("directive"),
            F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"),
        ),
    )


@checks.site("C001", "Robots Txt Missing", "Warning", "Site")
def robots_missing(site: Site) -> On:
    return site.everywhere(F.col("robots_txt").isNull())


@checks.site("C002", "Robots Txt Invalid", "Warning", "Site")
def robots_invalid(site: Site) -> On:
    return site.everywhere(F.exists(_lines(F.col("robots_txt")), lambda x: ~x["directive"].isin(*DIRECTIVES)))


@checks.site("C003", "Robots Txt Blocks Site", "Error", "Site")
def robots_blocks_site(site: Site) -> On:
    """Disallow: / while the latest user agent is exactly the wildcard; agent groups don't merge."""
    start = F.struct(F.lit("").alias("agent"), F.lit(False).alias("blocked"))

    def step(state: Column, line: Column) -> Column:
        agent = F.when(line["directive"] == "user-agent", line["value"]).otherwise(state["agent"])
        hit = (line["directive"] == "disallow") & (line["value"] == "/") & (state["agent"] == "*")
        return F.struct(agent.alias("agent"), (state["blocked"] | hit).alias("blocked"))

    return site.everywhere(F.aggregate(_lines(F.col("robots_txt")), start, step)["blocked"])


@checks.site("C004", "Robots Txt Blocks Assets", "Warning", "Site")
def robots_blocks_assets(site: Site) -> On:
    blocking = lambda x: (x["directive"] == "disallow") & x["value"].rlike(ASSETS)
    return site.everywhere(F.exists(_lines(F.col("robots_txt")), blocking))


@checks.site("C005", "Sitemap Missing", "Warning", "Site")
def sitemap_missing(site: Site) -> On:
    return site.everywhere(~F.coalesce("sitemap_found", F.lit(False)))


@checks.site("C006", "Sitemap Invalid", "Error", "Site")
def sitemap_invalid(site: Site) -> On:
    return site.everywhere(F.col("sitemap_found") & (F.col("sitemap_valid") == False))  # noqa: E712


def _in_sitemap(condition: Column) -> On:
    return On("sitemap", condition)


@checks.site("C007", "Sitemap Contains Broken URLs", "Error", "Site")
def sitemap_broken(site: Site) -> On:
    return _in_sitemap(urls.broken(F.col("status")))


@checks.site("C008", "Sitemap Contains Redirected URLs", "Warning", "Site")
def sitemap_redirected(site: Site) -> On:
    return _in_sitemap(urls.redirecting(F.col("status")))


@checks.site("C009", "Sitemap Contains Noindex URLs", "Warning", "Site")
def sitemap_noindex(site: Site) -> On:
    return _in_sitemap(robots_meta().contains("noindex"))


@checks.site("C010", "Sitemap Not In Robots", "Notice", "Site")
def sitemap_undeclared(site: Site) -> On:
    return site.everywhere(F.col("sitemap_found") & ~F.coalesce("sitemap_declared_in_robots", F.lit(False)))


@checks.site("C011", "Page Blocked By Robots Txt", "Error", extra=True)
def page_blocked(site: Site) -> DataFrame:
    """Pages whose path the wildcard group of robots.txt disallows; the longest matching rule wins."""
    rules = F.broadcast(site.context.limit(1).select(F.coalesce("robots_txt", F.lit("")).alias("robots_txt")))
    return site.crawl.select("url").join(rules).where(blocked_paths("url", "robots_txt", "longest")).select("url")


@checks.page("C012", "Noindex Directive", "Warning")
def noindex() -> Column:
    return robots_meta().contains("noindex")


@checks.page("C013", "Meta Nofollow", "Warning")
def nofollow() -> Column:
    return robots_meta().contains("nofollow")


@checks.page("C014", "Not Crawlable", "Error")
def not_crawlable() -> Column:
    return F.col("crawl_status").startswith("Error")


@checks.page("C015", "Soft 404", "Warning")
def soft_404() -> Column:
    return F.col("status").startswith("200") & (F.col("word_count") < SOFT_404_WORDS) & F.col("h.text").rlike(NOT_FOUND)


@checks.page("C016", "Conflicting Robots Signals", "Warning")
def conflicting_robots() -> Column:
    header = F.lower(F.coalesce("x_robots_tag", F.lit("")))
    differ = lambda word: header.contains(word) != robots_meta().contains(word)
    return (header != "") & (differ("noindex") | differ("nofollow"))


@checks.site("C017", "Canonical Points To Noindex", "Error")
def canonical_noindex(site: Site) -> DataFrame:
    hidden = site.crawl.where(robots_meta().contains("noindex")).select(F.col("url").alias("target"))
    pages = site.crawl.select("url", canonical().alias("target")).where("target <> '' AND target <> trim(url)")
    return pages.join(hidden, "target", "left_semi")


@checks.page("C018", "Cross-Domain Canonical", "Warning")
def cross_domain_canonical() -> Column:
    host = urls.netloc(canonical())
    return (host != "") & (host != urls.netloc(F.col("url")))


@checks.site("C019", "Canonical Chain", "Warning")
def canonical_chain(site: Site) -> DataFrame:
    own = site.crawl.select("url", canonical().alias("target"))
    moved = own.where("target <> '' AND target <> url").select(F.col("url").alias("target"))
    return own.where("target <> '' AND target <> trim(url)").join(moved, "target", "left_semi")


@checks.page("C020", "Pagination Signals Missing", "Notice")
def pagination_signals() -> Column:
    own = (canonical() != "") & (canonical() == F.trim("url"))
    return F.col("url").rlike(PAGINATION) & ~has_rel(r"(?iU)\b(next|prev)\b") & ~own
