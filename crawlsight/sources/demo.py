"""A synthetic crawl derived from the ``pages`` table, for queries and tests.

The tables at hand hold no canonical links, images, forms, headers, redirects or
probes. One SQL text, which Spark and other engines read alike, derives a crawl of
one site from them: row i of n gets a URL, a status and a page whose markup depends
on i alone, so that every check has pages that pass and pages that fail.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import Site, site
from ..schemas import SITE
from .pages import crawl_table
from .storage import materialised

#: The certificate's end and the time of the audit.
AS_OF = datetime(2024, 6, 1)
ROBOTS = "User-agent: *\nDisallow: /\nDisallow: /static/\nNoindex: /x\nSitemap: https://site.example/sitemap.xml\n"

_FILLER = "the and of to in is for that this with "
_FRENCH = "le la de et les des est que pour dans "

#: Rows of the crawl. ``ok`` rows have a page; ``t1`` and ``t2`` are the rows that a page links to.
ROWS_SQL = """
SELECT i, n, status, status = '200' AS ok,
  CASE status WHEN '200' THEN 'Success' WHEN '301' THEN 'Redirect' WHEN 'Error' THEN 'Error: timeout' ELSE 'HTTP Error' END AS crawl_status,
  2 * i + 1 AS t1, 2 * i + 2 AS t2, (i * 9 + 4) % n AS t3,
  CASE i WHEN 10 THEN 17 WHEN 17 THEN 10 ELSE (i * 15 + 7) % n END AS moved
FROM (
  SELECT i, n, CASE WHEN i % 7 = 3 THEN '301' WHEN i % 11 = 5 THEN '404' WHEN i % 29 = 13 THEN '500' WHEN i % 31 = 9 THEN 'Error' ELSE '200' END AS status
  FROM (SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS INT) AS i, CAST(count(*) OVER () AS INT) AS n FROM pages) r
) s
"""


def url_sql(i: str) -> str:
    """The URL of row ``i``, an SQL expression."""
    return f"""(CASE WHEN {i} = 0 THEN 'https://site.example/' ELSE concat(
      CASE WHEN {i} % 13 = 12 THEN 'http://' ELSE 'https://' END,
      CASE WHEN {i} % 19 = 18 THEN 'www.site.example' ELSE 'site.example' END,
      CASE WHEN {i} % 17 = 4 THEN '/shop/' WHEN {i} % 17 = 5 THEN '/news/' ELSE '/sec/' END,
      CASE WHEN {i} % 5 = 1 THEN 'Long_Name-' ELSE 'page-' END, CAST({i} AS STRING),
      CASE WHEN {i} % 37 = 6 THEN concat('/', repeat('very-long-part-', 8)) ELSE '' END,
      CASE WHEN {i} % 23 = 7 THEN concat('/', CAST(10000000 + {i} AS STRING)) ELSE '' END,
      CASE WHEN {i} % 41 = 8 THEN '?a=1&b=2&c=3&d=4' WHEN {i} % 15 = 2 THEN concat('?page=', CAST({i} AS STRING)) ELSE '' END) END)"""


#: SQL conditions on i, by the feature of the page that they switch on.
FEATURES = {
    "noindex": "i % 8 = 5",
    "nofollow_meta": "i % 12 = 2",
    "lost": "i % 16 = 4",
    "no_title": "i % 20 = 11",
    "long_title": "i % 9 = 2",
    "short_title": "i % 9 = 4",
    "no_description": "i % 6 = 5",
    "long_description": "i % 10 = 3",
    "short_description": "i % 10 = 4",
    "no_h1": "i % 14 = 8",
    "two_h1": "i % 14 = 6",
    "title_h1": "i % 14 = 4",
    "skip": "i % 18 = 6",
    "rich": "i % 3 = 0",
    "french": "i % 21 = 6",
    "no_lang": "i % 9 = 8",
    "lang_fr": "i % 16 = 12",
    "canonical_self": "i % 4 = 0",
    "canonical_next": "i % 4 = 2",
    "canonical_out": "i % 4 = 1",
    "rel_next": "i % 15 = 2 AND i % 2 = 0",
    "rel_first": "i % 15 = 2 AND i % 4 = 0",
    "mixed": "i % 22 = 4",
    "refresh": "i % 24 = 1",
    "many_links": "i % 64 = 12",
    "nofollow_link": "i % 25 = 6",
    "generic": "i % 25 = 8",
    "breadcrumb": "i % 2 = 0",
    "outer": "i % 6 = 2",
    "insecure_outer": "i % 26 = 8",
    "affiliate": "i % 26 = 10",
    "script_link": "i % 26 = 14",
    "tracking": "i % 26 = 16",
    "form": "i % 12 = 6",
    "labelled": "i % 24 = 6",
    "image": "i % 5 = 0",
    "image_alt": "i % 10 = 0",
    "image_sized": "i % 15 = 0",
    "image_png": "i % 20 = 0",
    "image_out": "i % 25 = 0",
    "image_second": "i % 30 = 0",
    "hreflang": "i % 8 = 4",
    "hreflang_bad": "i % 40 = 4",
    "hreflang_default": "i % 16 = 4",
    "hreflang_twice": "i % 48 = 4",
    "schema": "i % 7 = 0",
    "schema_full": "i % 14 = 0",
    "schema_bad": "i % 28 = 2",
    "social": "i % 3 = 1",
    "icon": "i % 4 = 3",
    "viewport": "i % 2 = 1",
    "blocking": "i % 32 = 4",
    "big": "i % 64 = 2",
    "affluent": "i % 44 = 2",
}


def _if(feature: str, text: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {FEATURES[feature]} THEN {text} ELSE {otherwise} END"


def title_sql() -> str:
    return (
        f"CASE WHEN {FEATURES['no_title']} THEN '' WHEN {FEATURES['long_title']} THEN concat('Garden tools and flowers for every season of the year, part ', CAST(i AS STRING)) "
        f"WHEN {FEATURES['short_title']} THEN 'Garden' ELSE concat('Garden tools and flowers, page ', CAST(i % 40 AS STRING)) END"
    )


def h1_sql() -> str:
    return (
        f"CASE WHEN {FEATURES['no_h1']} THEN '' WHEN {FEATURES['title_h1']} THEN {title_sql()} "
        "ELSE concat('Flowers ', CAST(i % 60 AS STRING)) END"
    )


def description_sql() -> str:
    return (
        f"CASE WHEN {FEATURES['no_description']} THEN '' WHEN {FEATURES['long_description']} THEN repeat('A very long description. ', 8) "
        f"WHEN {FEATURES['short_description']} THEN 'Short.' ELSE concat('A description of ordinary length that says what is to be found on the page ', CAST(i % 50 AS STRING)) END"
    )


def canonical_sql() -> str:
    return (
        f"CASE WHEN {FEATURES['canonical_self']} THEN {url_sql('i')} WHEN {FEATURES['canonical_next']} THEN {url_sql('t1')} "
        f"WHEN {FEATURES['canonical_out']} THEN 'https://other.example/x' ELSE '' END"
    )


def filler_sql() -> str:
    """Body words: 400 or 40 of them."""
    return (
        f"repeat(CASE WHEN {FEATURES['french']} THEN '{_FRENCH}' ELSE '{_FILLER}' END, CASE WHEN {FEATURES['rich']} THEN 40 ELSE 4 END)"
    )


def html_sql() -> str:
    """The page of row i."""
    link = lambda t, text: f"concat('<a href=\"', {url_sql(t)}, '\">{text}</a> ')"
    parts = [
        "'<!DOCTYPE html><html'",
        f"CASE WHEN {FEATURES['no_lang']} THEN '' WHEN {FEATURES['lang_fr']} THEN ' lang=\"fr\"' ELSE ' lang=\"en\"' END",
        "'><head>'",
        f"CASE WHEN {FEATURES['no_title']} THEN '' ELSE concat('<title>', {title_sql()}, '</title>') END",
        f"CASE WHEN {FEATURES['no_description']} THEN '' ELSE concat('<meta name=\"description\" content=\"', {description_sql()}, '\">') END",
        _if("noindex", "'<META NAME=\"Robots\" CONTENT=\"NOINDEX\">'"),
        f"CASE WHEN {FEATURES['nofollow_meta']} AND NOT ({FEATURES['noindex']}) THEN '<meta name=\"robots\" content=\"nofollow\">' ELSE '' END",
        f"CASE WHEN i % 4 <> 3 THEN concat('<link rel=\"canonical\" href=\"', {canonical_sql()}, '\">') ELSE '' END",
        _if("rel_next", "'<link rel=\"next\" href=\"/n\">'"),
        _if("rel_first", "'<link rel=\"first\" href=\"/f\">'"),
        _if("refresh", "'<meta http-equiv=\"Refresh\" content=\"5\">'"),
        _if("hreflang", f"concat('<link rel=\"alternate\" hreflang=\"en\" href=\"', {url_sql('i')}, '\"><link rel=\"alternate\" hreflang=\"fr\" href=\"', {url_sql('t1')}, '\"><link rel=\"alternate\" hreflang=\"de\" href=\"', {url_sql('t3')}, '\">')"),
        _if("hreflang_bad", "'<link rel=\"alternate\" hreflang=\"english\" href=\"https://other.example/en\">'"),
        _if("hreflang_default", "'<link rel=\"alternate\" hreflang=\"x-default\" href=\"https://other.example/\">'"),
        _if("hreflang_twice", "'<link rel=\"alternate\" hreflang=\"X-Default\" href=\"https://other.example/2\"><link rel=\"alternate\" hreflang=\"de\" href=\"https://other.example/de\">'"),
        _if("schema", f"concat('<script type=\"application/ld+json\">{{\"@type\":\"Product\"', {_if('schema_full', '\',\"name\":\"Spade\"\'')}, '}}</script>')"),
        _if("schema_bad", "'<script type=\"application/ld+json\">{bad</script>'"),
        _if("social", "'<meta property=\"og:title\" content=\"T\"><meta property=\"og:description\" content=\"D\"><meta name=\"twitter:card\" content=\"summary\">'"),
        _if("icon", "'<link rel=\"shortcut icon\" href=\"/favicon.ico\">'"),
        _if("viewport", "'<meta name=\"viewport\" content=\"width=device-width\">'"),
        _if("blocking", "'<script src=\"/a.js\"></script>'"),
        "'</head><body>'",
        f"CASE WHEN {FEATURES['no_h1']} THEN '' ELSE concat('<h1>', {h1_sql()}, '</h1>') END",
        _if("two_h1", "'<h1>Second</h1>'"),
        _if("skip", "'<h3>Deep</h3>'"),
        _if("lost", "'<p>Page not found</p>'"),
        f"concat('<p>', {filler_sql()}, '</p>')",
        _if("breadcrumb", "'<nav aria-label=\"Breadcrumb\"></nav>'"),
        f"CASE WHEN t1 < n THEN {link('t1', 'flowers here')} ELSE '' END",
        f"CASE WHEN t2 < n THEN {link('t2', 'garden tools')} ELSE '' END",
        link("t3", "blue widgets"),
        _if("many_links", "repeat('<a href=\"/many\">many links</a> ', 101)"),
        _if("nofollow_link", "'<a href=\"/quiet\" rel=\"nofollow\">quiet place</a> '"),
        _if("generic", "'<a href=\"/generic\">Click here</a> '"),
        _if("outer", "concat('<a href=\"https://out.example/', CAST(i % 4 AS STRING), '\">outer</a> ')"),
        _if("insecure_outer", "'<a href=\"http://plain.example/\">plain</a> '"),
        _if("affiliate", "'<a href=\"https://amzn.to/x\">shop</a> '"),
        _if("script_link", "'<a href=\"javascript:void(0)\">menu</a> '"),
        _if("tracking", "'<a href=\"/t?utm_source=a\">tracked</a> '"),
        _if("affluent", "repeat('<a href=\"https://rich.example/\">rich</a> ', 5)"),
        _if("form", f"concat('<form action=\"http://form.example/\"><input type=\"text\" name=\"q\"', {_if('labelled', '\' aria-label=\"query\"\'')}, '></form>')"),
        _if("image", f"concat('<img src=\"', {_if('image_out', '\'https://cdn.example/a\'', '\'/img/a\'')}, {_if('image_png', '\'.PNG\'', '\'.webp\'')}, '\"', {_if('image_alt', '\' alt=\"picture\"\'', '\' alt=\"\"\'')}, {_if('image_sized', '\' width=\"1\" height=\"1\"\'')}, '>')"),
        _if("image_second", "'<img src=\"/img/b.webp\" alt=\"b\" width=\"1\" height=\"1\">'"),
        _if("mixed", "'<script src=\"http://plain.example/a.js\" async></script>'"),
        _if("big", "repeat('<i></i>', 1500)"),
        "'</body></html>'",
    ]
    return "concat(" + ",\n  ".join(parts) + ")"


def fetched_sql() -> str:
    """The crawl before parsing, as SQL over ``pages``."""
    header = lambda cond, value: f"CASE WHEN ok AND {cond} THEN '{value}' WHEN ok THEN '' END"
    return f"""
SELECT i, n, t1, t2, t3, ok, {url_sql("i")} AS url, status, crawl_status,
  CASE WHEN ok THEN 'text/html' ELSE '' END AS mime_type,
  CAST(CASE WHEN i % 27 = 0 THEN 3.5 ELSE 0.5 END AS DOUBLE) AS crawl_time_s,
  CASE WHEN ok THEN {html_sql()} ELSE '' END AS html,
  CASE WHEN status = '301' THEN {url_sql("moved")} END AS redirect_target,
  {header("i % 3 = 0", "gzip")} AS content_encoding,
  {header("i % 4 = 0", "max-age=1")} AS strict_transport_security,
  {header("i % 5 = 0", "nosniff")} AS x_content_type_options,
  {header("i % 6 = 0", "DENY")} AS x_frame_options,
  {header("i % 7 = 0", "default-src")} AS content_security_policy,
  {header("i % 8 = 0", "no-cache")} AS cache_control,
  {header("(i % 16 = 1 OR i % 16 = 5)", "noindex")} AS x_robots_tag
FROM ({ROWS_SQL}) rows_"""


SITEMAP_SQL = f"SELECT {url_sql('i')} AS url FROM ({ROWS_SQL}) r WHERE i % 3 <> 1"
_entry = lambda code, href, cond: f"SELECT {url_sql('i')} AS url, '{code}' AS code, {href} AS href FROM ({ROWS_SQL}) r WHERE ok AND {cond}"
SITEMAP_HREFLANG_SQL = " UNION ALL ".join(
    [
        _entry("en", url_sql("i"), "i % 8 = 4"),
        _entry("fr", url_sql("t1"), "i % 16 = 12"),
        _entry("de", url_sql("t3"), "i % 16 = 12"),
    ]
)
LINK_PROBE_SQL = """
SELECT concat('https://out.example/', CAST(k AS STRING)) AS url, CASE WHEN k = 0 THEN 404 WHEN k = 2 THEN 200 END AS status,
  k = 2 AS redirected, k = 0 AS robots_blocked FROM (SELECT 0 AS k UNION ALL SELECT 2) p"""


#: Field measurements: four of each metric a page, in steps that depend on i.
VITALS_SQL = f"""
SELECT {url_sql("i")} AS url, m AS metric, CAST((i * 7 + k * 11) % 40 * step AS DOUBLE) AS value
FROM ({ROWS_SQL}) r CROSS JOIN (SELECT 'LCP' AS m, 100.0 AS step UNION ALL SELECT 'INP', 8.0 UNION ALL SELECT 'CLS', 0.005) v
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t WHERE ok"""


#: Rows whose pages one task makes and parses.
ROWS_A_TASK = 1000

#: What numbers the rows in ROWS_SQL, for engines that do so in one place.
_NUMBERED = "SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS INT) AS i, CAST(count(*) OVER () AS INT) AS n FROM pages"


def numbered(pages: DataFrame) -> DataFrame:
    """(i, n): the rows' numbers in order of page_id and how many there are, without gathering them in a task.

    Rows are dealt by range and sorted there; a part's numbers begin behind those of the parts before it.
    The numbers are so small that Spark reads them in few tasks, so they are dealt anew to as many as
    the pages that are made from them need.
    """
    spark = pages.sparkSession
    dealt = pages.select("page_id").repartitionByRange("page_id").sortWithinPartitions("page_id")
    placed = dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = materialised(spark, placed, "numbered")
    tasks = -(-max(1, placed.count()) // ROWS_A_TASK)
    parts = placed.groupBy("part").agg(F.count("*").alias("held"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    begin = parts.select("part", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("begin"), F.sum("held").over(Window.partitionBy()).alias("n"))
    rows = placed.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("at")).cast("int").alias("i"), F.col("n").cast("int").alias("n"))
    return rows.repartition(tasks)


def demo_site(spark: SparkSession, pages: DataFrame) -> Site:
    """The derived site. Its crawl is parsed once and written, so that each check reads only its columns."""
    view = f"numbered_{uuid.uuid4().hex}"
    numbered(pages).createOrReplaceTempView(view)
    sql = lambda text: spark.sql(text.replace(_NUMBERED, f"SELECT i, n FROM {view}"))
    rows = sql(fetched_sql())
    crawl = materialised(spark, crawl_table(rows).drop("i", "n", "t1", "t2", "t3", "ok"), "demo")
    ssl = (True, datetime(2024, 6, 11), False, False)
    context = (ROBOTS, "https://site.example/robots.txt", "https://site.example/sitemap.xml", False, True, False, ssl)
    context = spark.createDataFrame([(*context, "https://site.example/favicon.ico", 404, False, False)], SITE)
    sitemap, hreflang, measured = sql(SITEMAP_SQL), sql(SITEMAP_HREFLANG_SQL), sql(VITALS_SQL)
    spark.catalog.dropTempView(view)
    return site(
        crawl,
        context,
        sitemap,
        hreflang,
        spark.sql(LINK_PROBE_SQL),
        spark.createDataFrame([("https://site.example/img/a.webp", 404), ("https://site.example/img/a.PNG", 200)], "url string, status int"),
        AS_OF,
        measured,
    )


