"""Sitemap files, read by as many tasks as their size asks for.

Files are read as text records that end where an entry's tag ends, which splits one large
sitemap between tasks; each entry is then parsed by native XML functions. Files are told apart
by their path: one is malformed if an entry doesn't parse, if what stands between entries is no
balanced markup, if entries don't close as often as they open, or if its root doesn't open and
close once. A malformed file gives no rows, and says so in the table of files. Namespace prefixes
don't matter.

Edge cases: an empty file has no record and no row anywhere; a sitemap index has the locations of its sitemaps; a
file without entries is one record; an entry of any length is read whole. Tags of entries end in
``url>`` as the protocol's files have them: one with a blank before the bracket, or another
element of that name inside an entry, makes a file malformed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialised

#: What ends a record: an entry's opening or closing tag, whatever its prefix.
TAG_END = "url>"
_ROOTS = "urlset|sitemapindex"


def _parses(xml: Column) -> Column:
    """Whether a piece is well-formed."""
    schema = "a string, _corrupt_record string"
    return F.from_xml(xml, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNull()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, rest, opened, opens, closes): an entry's markup or null, the markup beside it without the root's tags, entries that open here, and the root's tags."""
    raw = spark.read.text(path, lineSep=TAG_END).select("value", F.col("_metadata.file_path").alias("file"))
    tag = r"</?([A-Za-z_][\w.\-]*:)?$"
    ends = F.regexp_substr("value", F.lit(tag))
    # Prefixes go; comments, instructions and the document type are no markup.
    plain = F.regexp_replace(F.regexp_replace("value", tag, ""), r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>|\x{FEFF}", "")
    plain = F.regexp_replace(plain, r"<(/?)[A-Za-z_][\w.\-]*:", "<$1")
    plain = F.regexp_replace(plain, r"\s(?!xmlns)[A-Za-z_][\w.\-]*:([A-Za-z_][\w.\-]*\s*=)", " $1")
    found = raw.select("file", plain.alias("text"), F.coalesce(ends.startswith("</"), F.lit(False)).alias("closing"), ends.isNotNull().alias("tag"))
    # An opening tag with attributes stands inside its entry's record.
    at = F.when(F.col("closing"), F.regexp_instr("text", F.lit(r"<url\s"))).otherwise(0)
    entry = F.when(at > 0, F.concat(F.substr("text", at), F.lit("</url>"))).when(F.col("closing"), F.concat(F.lit("<url>"), "text", F.lit("</url>")))
    before = F.when(at > 0, F.substr("text", F.lit(1), at - 1)).when(F.col("closing"), "").otherwise(F.col("text"))
    opening, closing = rf"<({_ROOTS})(\s[^>]*)?>", rf"</({_ROOTS})\s*>"
    opened = (F.col("tag") & ~F.col("closing")).cast("int") + (at > 0).cast("int")
    return found.select("file", entry.alias("entry"), before.alias("before"), opened.alias("opened")).select(
        "file",
        "entry",
        F.regexp_replace(F.regexp_replace("before", opening, ""), closing, "").alias("rest"),
        "opened",
        F.regexp_count("before", F.lit(opening)).alias("opens"),
        F.regexp_count("before", F.lit(closing)).alias("closes"),
    )


def read_sitemaps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, sitemap_urls, sitemap_hreflang) of the files under ``path``; files has (file, entries, valid).

    Records are read and judged once, and written.
    """
    wrapped = F.concat(F.lit("<r>"), "rest", F.lit("</r>"))
    sound = (F.col("entry").isNull() | _parses(F.col("entry"))) & ((F.trim("rest") == "") | _parses(wrapped))
    judged = materialised(spark, records(spark, path).withColumn("sound", sound), "sitemap-records")
    files = judged.groupBy("file").agg(
        F.count("entry").alias("entries"),
        (F.bool_and("sound") & (F.sum("opened") == F.count("entry")) & (F.sum("opens") == 1) & (F.sum("closes") == 1)).alias("valid"),
    )
    good = judged.join(files.where("valid").select("file"), "file", "left_semi")
    # Parses are guarded, as the plan may come to them before the join.
    outside = F.when(F.col("sound") & (F.trim("rest") != ""), F.xpath(wrapped, F.lit("//loc/text()")))
    entry = F.when(F.col("sound"), F.col("entry"))
    none = F.array().cast("array<string>")
    locations = F.concat(F.coalesce(outside, none), F.coalesce(F.xpath(entry, F.lit("//loc/text()")), none))
    blanks = F.lit(" \t\r\n")
    urls = good.select(F.explode(locations).alias("url")).select(F.btrim("url", blanks).alias("url"))
    link = "/url/link[@rel='alternate'][@hreflang!=''][@href!='']"
    codes, hrefs = F.xpath(entry, F.lit(f"{link}/@hreflang")), F.xpath(entry, F.lit(f"{link}/@href"))
    own = F.btrim(F.xpath_string(entry, F.lit("/url/loc[1]/text()")), blanks)
    links = good.select(own.alias("url"), F.explode(F.arrays_zip(codes.alias("code"), hrefs.alias("href"))).alias("k"))
    links = links.select("url", F.lower(F.trim("k.code")).alias("code"), F.col("k.href").alias("href"))
    return files, urls.where("url <> ''"), links.where("url <> ''")
