"""Counts and averages over a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(crawl: DataFrame) -> DataFrame:
    """One row: pages, successes with their whole percentage, errors."""
    success = F.count_if(F.col("crawl_status") == "Success")
    return crawl.agg(
        F.count("*").alias("pages"),
        success.alias("successful"),
        (success / F.greatest(F.lit(1), F.count("*")) * 100).cast("int").alias("successful_percent"),
        F.count_if(F.col("crawl_status") != "Success").alias("errors"),
    )


def averages(crawl: DataFrame) -> DataFrame:
    """One row of the summary sheet: whole averages of lengths and words, rounded ones of the rest."""
    whole = lambda c: F.avg(c).cast("int")
    return crawl.agg(
        F.count("*").alias("pages_crawled"),
        whole(F.length("title")).alias("avg_title_length"),
        whole(F.length("description")).alias("avg_description_length"),
        whole("word_count").alias("avg_word_count"),
        F.round(F.avg("heading_count"), 1).alias("avg_heading_count"),
        F.round(F.avg("image_count"), 1).alias("avg_image_count"),
        F.round(F.avg("crawl_time_s"), 2).alias("avg_crawl_time_s"),
    )


def value_counts(crawl: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, most frequent first."""
    return crawl.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def average_by(crawl: DataFrame, key: str, column: str) -> DataFrame:
    """(key, mean) of a column per key."""
    return crawl.groupBy(F.col(key).alias("key")).agg(F.avg(column).alias("mean"))


def of_mime_types(crawl: DataFrame, wanted: list[str] | None) -> DataFrame:
    """The crawl cut down to some MIME types; all without a choice."""
    return crawl if not wanted else crawl.where(F.col("mime_type").isin(wanted))
