"""Checks on pages as they arrive.

Page rules look at one row, so they run unchanged on a stream. Rules that compare
pages run per micro-batch against the tables written so far, through foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.health import checks, page_flags
from ..sources.pages import crawl_table


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Pages from a folder that grows."""
    return spark.readStream.schema(schema).parquet(path)


def stream_flags(pages: DataFrame) -> DataFrame:
    """(check_id, url) of all page rules on a stream of (url, html); stateless, in append mode."""
    crawl = crawl_table(pages).withColumn("has_headers", F.lit(False))
    return page_flags(crawl, [c for c in checks() if c.per_page])


def each_batch(pages: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each batch's crawl table to ``report`` exactly once per batch number."""
    return pages.writeStream.foreachBatch(lambda batch, n: report(crawl_table(batch), n)).option("checkpointLocation", checkpoint)
